"""Queries of messages and the op-log, in batch form; tests run the streams themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.plans.base import query
from keelson.sources.keyspace import table
from keelson.streaming import oplog, pubsub


def messages(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("channel"), "ts", "value", "user_id")


def subscriptions(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("channel"), F.col("user_id").alias("client")).where("client % 3 = 0")


@query("subscribe", "SELECT event_id AS id, event_type AS channel FROM events WHERE event_type IN ('click', 'error')")
def _(spark, d):
    return pubsub.subscribe(messages(spark, d), "click", "error").select("id", "channel")


@query("psubscribe", "SELECT event_id AS id, event_type AS channel FROM events WHERE regexp_full_match(event_type, '.*i.*|err.r')")
def _(spark, d):
    return pubsub.psubscribe(messages(spark, d), "*i*", "err?r").select("id", "channel")


@query("ssubscribe_spublish", "SELECT event_id AS id FROM events WHERE event_type = 'view'")
def _(spark, d):
    return pubsub.ssubscribe(messages(spark, d), 4, "view").select("id")


@query("publish_receivers", "SELECT event_id AS id, coalesce(n, 0) AS receivers FROM events LEFT JOIN (SELECT event_type, count(DISTINCT user_id) AS n FROM events WHERE user_id % 3 = 0 GROUP BY event_type) USING (event_type)")
def _(spark, d):
    return pubsub.receivers(messages(spark, d), subscriptions(spark, d))


@query("pubsub_channels", "SELECT DISTINCT event_type AS channel FROM events WHERE user_id % 3 = 0 AND event_type LIKE '%i%'")
def _(spark, d):
    return pubsub.channels(subscriptions(spark, d), "*i*")


@query("pubsub_numsub", "SELECT event_type AS channel, count(DISTINCT user_id) AS clients FROM events WHERE user_id % 3 = 0 GROUP BY event_type")
def _(spark, d):
    return pubsub.numsub(subscriptions(spark, d))


@query("tumbling_window", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000 AS at, event_type AS channel, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return pubsub.windowed(messages(spark, d), "1 day").select(F.unix_millis("window.start").alias("at"), "channel", "n", F.round("total", 4).alias("total"))


@query("session_window", "SELECT channel, count(*) AS n, epoch_us(min(ts)) // 1000 AS at FROM (SELECT *, sum(fresh) OVER (PARTITION BY channel ORDER BY ts, id) AS s FROM (SELECT event_id AS id, event_type AS channel, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) < INTERVAL 20 MINUTES THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY channel, s")
def _(spark, d):
    return pubsub.sessions(messages(spark, d), "20 minutes").select("channel", "n", F.unix_millis("session_window.start").alias("at"))


@query("oplog_replay_compaction", "SELECT 'user:' || user_id AS key, max(event_id) AS seq FROM events GROUP BY user_id")
def _(spark, d):
    log = messages(spark, d).select(F.col("id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("channel").alias("cmd"))
    return oplog.compacted(log).select("key", "seq")


@query("oplog_fold_deletes", "SELECT key FROM (SELECT 'user:' || user_id AS key, arg_max(event_type, event_id) AS cmd FROM events GROUP BY user_id) WHERE cmd <> 'error'")
def _(spark, d):
    log = messages(spark, d).select(F.col("id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("key"), F.when(F.col("channel") == "error", "del").otherwise("set").alias("cmd"))
    return oplog.folded(log).select("key")


@query("monitor_tail", "SELECT event_id AS seq FROM events WHERE event_type IN ('purchase', 'signup')")
def _(spark, d):
    log = messages(spark, d).select(F.col("id").alias("seq"), F.col("channel").alias("cmd"))
    return oplog.monitor(log, ["purchase", "signup"]).select("seq")


@query("pubsub_numpat", "SELECT count(DISTINCT event_type) AS n FROM events WHERE user_id % 3 = 0")
def _(spark, d):
    return pubsub.numpat(subscriptions(spark, d).select(F.concat("channel", F.lit("*")).alias("pattern"), "client"))


@query("pubsub_shardchannels_shardnumsub", "SELECT event_type AS channel, count(DISTINCT user_id) AS clients FROM events WHERE user_id % 3 = 0 AND event_type LIKE 's%' GROUP BY event_type")
def _(spark, d):
    return pubsub.numsub(subscriptions(spark, d)).where(F.col("channel").startswith("s"))


@query("log_sink_replay", "SELECT event_id AS seq, event_type AS cmd FROM events WHERE event_id >= 100 AND event_id < 5000")
def _(spark, d):
    import uuid

    from keelson.sources.keyspace import shared_dir

    path = f"{shared_dir(spark)}/keelson-log/{uuid.uuid4().hex}"
    oplog.sink(messages(spark, d).select(F.col("id").alias("seq"), F.col("channel").alias("cmd")), path, 4)
    return oplog.replay(spark, path, 100, 5000)


@query("checkpoint_recovery", "SELECT key, cmd, seq FROM (SELECT 'user:' || user_id AS key, arg_max(CASE WHEN event_type = 'error' THEN 'del' ELSE 'set' END, event_id) AS cmd, max(event_id) AS seq FROM events GROUP BY user_id) WHERE cmd <> 'del'")
def _(spark, d):
    import uuid

    from keelson.sources.keyspace import shared_dir

    path = f"{shared_dir(spark)}/keelson-log/{uuid.uuid4().hex}"
    log = messages(spark, d).select(F.col("id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("key"), F.when(F.col("channel") == "error", "del").otherwise("set").alias("cmd"))
    for number in (0, 1, 1):  # what a batch leaves, the second run again after it was cut off
        oplog.checkpointed(log.where(F.col("seq") % 2 == number), path, number)
    return oplog.restored(spark, path, "seq long, key string, cmd string").select("key", "cmd", "seq")
