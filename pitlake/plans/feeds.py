"""JSON feeds, stores, models, simulation and streaming over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import calibration as calibrators
from pitlake.operators import metrics, modelling
from pitlake.plans.base import Tables, query
from pitlake.sources import feeds, stores
from pitlake.streaming import capture

r6 = lambda c: F.round(c, 6)


def shared_folder(t: Tables, name: str) -> str:
    """A new folder all executors see."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"{name}-") + "/data"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def schedule_payloads(t: Tables) -> DataFrame:
    """A schedule payload per day of orders."""
    game = F.struct(
        F.col("o_orderkey").alias("gamePk"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("gameDate"), F.struct(F.col("o_orderstatus").alias("codedGameState"), F.col("o_orderpriority").alias("detailedState")).alias("status"),
        F.struct(*(F.struct(F.struct((F.col("o_custkey") % m).alias("id"), F.lit(n).alias("name")).alias("team"), (F.col("o_orderkey") % m).cast("int").alias("score")).alias(n) for n, m in (("home", 7), ("away", 5)))).alias("teams"),
    )
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sort_array(F.collect_list(game)).alias("games"))
    return days.select(F.to_json(F.struct(F.array(F.struct("games")).alias("dates"))).alias("payload"))


@query("a06_schedule_flatten", "SELECT o_orderkey AS game_pk, o_orderstatus AS state, o_custkey % 7 AS home_team_id, o_custkey % 5 AS away_team_id, (o_orderkey % 7)::INT AS home_score, o_custkey % 7 <> o_custkey % 5 AND o_orderkey > 0 AS valid FROM orders")
def schedule_flatten(t: Tables) -> DataFrame:
    """Nested schedule to rows, with per-record validity."""
    return feeds.schedule_games(schedule_payloads(t)).select("game_pk", "state", "home_team_id", "away_team_id", "home_score", "valid")


def odds_payloads(t: Tables) -> DataFrame:
    side = lambda name, price: F.struct(F.lit(name).alias("name"), price.cast("int").alias("price"), F.lit(None).cast("double").alias("point"))
    k = F.col("o_orderkey")
    pair = F.when(k % 11 == 0, F.array(side("H", 100 + k % 50))).otherwise(F.array(side("H", 100 + k % 50), side("A", -100 - k % 60)))
    markets = F.array(F.struct(F.lit("h2h").alias("key"), pair.alias("outcomes")))
    books = F.array(*(F.struct(F.lit(b).alias("key"), F.lit("2024-01-01T00:00:00Z").alias("last_update"), markets.alias("markets")) for b in ("one", "two")))
    event = F.struct(k.cast("string").alias("id"), F.lit("2024-01-02T00:00:00Z").alias("commence_time"), F.lit("H").alias("home_team"), F.lit("A").alias("away_team"), books.alias("bookmakers"))
    return t.orders.select(F.to_json(F.array(event)).alias("payload"))


@query("a17_market_outcomes", "SELECT o_orderkey AS event_id, book AS bookmaker, CASE WHEN o_orderkey % 11 = 0 THEN false ELSE true END AS ok FROM orders, (SELECT unnest(['one', 'two']) AS book)")
def market_outcomes(t: Tables) -> DataFrame:
    """Event - bookmaker - market - outcome flatten and cardinality of each market."""
    out = feeds.market_outcomes(odds_payloads(t), "h2h")
    return feeds.complete_markets(out, ("home", "away")).select(F.col("event_id").cast("long").alias("event_id"), "bookmaker", "ok")


@query("a21_quotes", "SELECT p_partkey, CASE WHEN p_size <= 40 THEN round(p_size / 40, 4) END AS bid FROM part")
def quotes(t: Tables) -> DataFrame:
    """Decimal-dollar quotes, out of range null."""
    m = F.struct(F.col("p_partkey").cast("string").alias("ticker"), F.lit("e").alias("event_ticker"), F.format_string("%.4f", F.col("p_size") / 40).alias("yes_bid_dollars"), F.lit("0.5").alias("yes_ask_dollars"), F.lit("x").alias("updated_time"))
    payload = t.part.select(F.to_json(F.struct(F.lit("c").alias("cursor"), F.array(m).alias("markets"))).alias("payload"))
    return feeds.quotes(payload).select(F.col("ticker").cast("long").alias("p_partkey"), F.col("bid").cast("double").alias("bid"))


@query("a24_archive_lines", "SELECT o_orderdate::DATE::VARCHAR AS archive_date, count(*) AS lines, count(*) FILTER (o_orderkey % 10 = 0) AS unpriced FROM orders GROUP BY 1")
def archive_lines(t: Tables) -> DataFrame:
    """Dated map of games to one row per line, price 0 is none."""
    team = lambda n: F.struct(F.lit(n).alias("fullName"))
    odds_ = F.struct((F.col("o_orderkey") % 10 * 30).cast("int").alias("homeOdds"), F.lit(-120).alias("awayOdds"))
    line = F.struct(F.lit("book").alias("sportsbook"), odds_.alias("openingLine"), odds_.alias("currentLine"))
    game = F.struct(F.struct(F.lit("x").alias("startDate"), team("H").alias("homeTeam"), team("A").alias("awayTeam")).alias("gameView"), F.struct(F.array(line).alias("moneyline")).alias("odds"))
    days = t.orders.groupBy(F.to_date("o_orderdate").cast("string").alias("d")).agg(F.collect_list(game).alias("g"))
    rows = feeds.archive_lines(days.select(F.to_json(F.create_map("d", "g")).alias("payload")))
    return rows.groupBy(F.col("archive_date").cast("string").alias("archive_date")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("opening_home").isNull()).alias("unpriced"))


@query("a27_append_store", "SELECT 'first' AS run, count(*) AS appended, 0::BIGINT AS skipped FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'second', count(*) FILTER (event_id % 2 = 1), count(*) FILTER (event_id % 2 = 0) FROM events")
def append_store(t: Tables) -> DataFrame:
    """Idempotent append by key."""
    path, cols = shared_folder(t, "store"), ["event_id", "user_id", "value"]
    one = stores.append_new(t.events.where("event_id % 2 = 0").select(*cols), path, ["event_id"])
    two = stores.append_new(t.events.select(*cols), path, ["event_id"])
    return t.spark.createDataFrame([("first", one["appended"], one["skipped"]), ("second", two["appended"], two["skipped"])], "run string, appended long, skipped long")


@query("a29_upsert", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM events")
def upsert(t: Tables) -> DataFrame:
    """Keyed upsert, last write wins."""
    new = t.events.where("event_id % 3 = 0").select("event_id", (F.col("value") + 1).alias("value"), F.lit(1).cast("long").alias("_ordinal"))
    stale = new.select("event_id", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("_ordinal"))
    return stores.upsert(t.events.select("event_id", "value"), new.unionByName(stale), ["event_id"])


@query("a30_partition_overwrite", "SELECT event_type, CASE WHEN event_type = 'click' THEN 1 ELSE count(*) END AS n FROM events GROUP BY 1")
def partition_overwrite(t: Tables) -> DataFrame:
    """One partition replaced, the others kept."""
    path = shared_folder(t, "partitions")
    stores.replace_partition(t.events.select("event_id", "event_type"), path, "event_type")
    stores.replace_partition(t.events.where("event_type = 'click'").agg(F.min("event_id").alias("event_id")).withColumn("event_type", F.lit("click")), path, "event_type")
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a10_delete_keys", "SELECT event_id FROM events WHERE user_id % 2 = 1")
def delete_keys(t: Tables) -> DataFrame:
    """A10: deletion by key."""
    return stores.delete_keys(t.events, t.events.where("user_id % 2 = 0"), ["user_id"]).select("event_id")


@query("a13_payload_hash", "SELECT event_id, sha256(props) AS sha, sha256(props) = sha256(props || CASE WHEN event_id % 50 = 0 THEN ' ' ELSE '' END) AS ok FROM events")
def payload_hash(t: Tables) -> DataFrame:
    """Payload hashes against published ones."""
    raw = t.events.select(F.col("event_id").alias("path"), F.concat("props", F.when(F.col("event_id") % 50 == 0, " ").otherwise("")).alias("content"))
    shas = t.events.select(F.col("event_id").alias("path"), F.sha2("props", 256).alias("sha256"))
    return stores.verified(raw, shas).join(shas, "path").select(F.col("path").alias("event_id"), F.col("sha256").alias("sha"), "ok")


@query("a26_json_lines", "SELECT event_id, value FROM events WHERE event_id % 10 <> 0")
def json_lines(t: Tables) -> DataFrame:
    """JSON lines written and read by schema, lines that aren't objects dropped."""
    path = shared_folder(t, "lines")
    t.events.select(F.when(F.col("event_id") % 10 == 0, F.lit("[1]x")).otherwise(F.to_json(F.struct("event_id", "value")))).write.text(path)
    return t.spark.read.schema("event_id long, value double").option("mode", "DROPMALFORMED").json(path).where("event_id IS NOT NULL")


@query("a37_status_view", """WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT c_custkey, CASE WHEN event_type IS NULL THEN 'missing' WHEN event_type = 'error' THEN 'failed' ELSE 'retained' END AS status FROM customer LEFT JOIN a ON user_id = c_custkey AND rn = 1""")
def status_view(t: Tables) -> DataFrame:
    """Dimension ⟕ latest attempt, status by case."""
    last = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("e"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.when(F.col("e").isNull(), "missing").when(F.col("e") == "error", "failed").otherwise("retained").alias("status"))


@query("a41_batches", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 500 AS batch FROM orders WHERE o_orderkey % 3 <> 0")
def batches(t: Tables) -> DataFrame:
    """What is left to fetch, in batches of fixed size."""
    from pyspark.sql import Window as W

    left = t.orders.join(t.orders.where("o_orderkey % 3 = 0").select("o_orderkey"), "o_orderkey", "left_anti")
    return left.select("o_orderkey", F.floor((F.row_number().over(W.partitionBy("o_orderstatus").orderBy("o_orderkey")) - 1) / 500).alias("batch"))


def matrix(t: Tables) -> DataFrame:
    """Orders with numeric features and a label, by season."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    m = t.orders.join(lines, "o_orderkey", "left").select(
        "o_orderkey", F.year("o_orderdate").alias("season"), (F.col("o_totalprice") / 1e5).alias("price"), "q", "d", (F.col("o_totalprice") + 1e5 * (F.col("o_orderkey") % 7 / 7) > 3e5).cast("double").alias("label"))
    return stored(t, m, "matrix")


def stored(t: Tables, df: DataFrame, name: str) -> DataFrame:
    """The frame as a table, as models read it many times."""
    path = shared_folder(t, name)
    df.write.parquet(path)
    return t.spark.read.parquet(path)


@query("j10_walk_forward")
def walk_forward(t: Tables) -> DataFrame:
    """All expanding folds, three models, metrics by model and fold and pooled."""
    m, features = matrix(t), ["price", "q", "d"]
    folds = modelling.expanding_folds([r[0] for r in m.where("season IS NOT NULL").select("season").distinct().collect()])
    p = None
    for kind in ("logistic", "forest", "boosted"):
        one = modelling.walk_forward(m, features, folds, lambda: modelling.pipeline(kind, features)).select(F.lit(kind).alias("model"), "fold", "label", "p")
        p = one if p is None else p.unionByName(one)
    return modelling.pooled(stored(t, p, "predictions"), by=["model"]).select("model", "fold", "n", *(F.round(c, 4).alias(c) for c in ("log_loss", "brier", "accuracy", "auc", "ece")))


@query("j16_calibration")
def calibration(t: Tables) -> DataFrame:
    """Sigmoid and isotonic calibration on the same split."""
    m = matrix(t)
    *train, before, last = sorted(r[0] for r in m.where("season IS NOT NULL").select("season").distinct().collect())
    folds = [(tuple(train), before), (tuple(train), last)]
    p = stored(t, modelling.walk_forward(m, ["price", "q", "d"], folds, lambda: modelling.pipeline("logistic", ["price", "q", "d"])), "predictions")
    out = None
    for method in ("sigmoid", "isotonic"):
        c = calibrators.fit(p.where(F.col("fold") == before), method)(p.where(F.col("fold") == last))
        row = c.agg(F.lit(method).alias("method"), F.count(F.lit(1)).alias("n"), F.round(metrics.brier(F.col("label"), F.col("p")), 4).alias("raw"), F.round(metrics.brier(F.col("label"), F.col("calibrated")), 4).alias("calibrated"))
        out = row if out is None else out.unionByName(row)
    return out


@query("j18_refit_calibration")
def refit_calibration(t: Tables) -> DataFrame:
    """Raw, sigmoid and isotonic variants of one refitted model over all expanding folds before the last season, with what they recommend."""
    m = matrix(t).where("season IS NOT NULL").join(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")), "o_orderkey")
    *seasons, _ = sorted(r[0] for r in m.select("season").distinct().collect())
    p, _ = calibrators.refit_variants(m, modelling.expanding_folds(seasons), lambda: modelling.pipeline("logistic", ["price", "q", "d"]), lambda df, name: stored(t, df, name), "day", "o_orderkey")
    x = calibrators.compare(p, "o_orderkey")
    advice = calibrators.recommend(x.collect())  # a row for each variant and fold
    return x.select("variant", "fold", "n", *(F.round(c, 4).alias(c) for c in ("log_loss", "brier", "ece", "lowest", "highest")), F.lit(advice).alias("recommendation"))


@query("m16_saved_calibrators")
def saved_calibrators(t: Tables) -> DataFrame:
    """Calibrators of one season saved, read back and applied to the next."""
    m = matrix(t)
    *train, before, last = sorted(r[0] for r in m.where("season IS NOT NULL").select("season").distinct().collect())
    p = stored(t, modelling.walk_forward(m, ["price", "q", "d"], [(tuple(train), before), (tuple(train), last)], lambda: modelling.pipeline("logistic", ["price", "q", "d"])), "predictions")
    path, out = shared_folder(t, "calibrators"), p.where(F.col("fold") == last).select("o_orderkey", "p")
    for method in calibrators.METHODS:
        calibrators.fit(p.where(F.col("fold") == before), method).save(path)
        out = calibrators.load(path, method)(out).withColumnRenamed("calibrated", method)
    return out.select("o_orderkey", *(F.round(c, 4).alias(c) for c in ("p", *calibrators.METHODS)))


@query("m17_locked_models")
def locked_models(t: Tables) -> DataFrame:
    """A locked classifier and a locked score model, saved, loaded and applied to the season after."""
    m = matrix(t).withColumn("runs", (F.col("q") % 9).cast("double"))
    *train, last = sorted(r[0] for r in m.where("season IS NOT NULL").select("season").distinct().collect())
    path, features = shared_folder(t, "locked"), ["price", "q", "d"]
    modelling.lock(m, train, lambda: modelling.pipeline("logistic", features), f"{path}/label")
    modelling.lock(m, train, lambda: modelling.run_rate_pipeline(["price", "d"], "runs"), f"{path}/runs", label="runs")
    held = m.where(F.col("season") == last)
    p = modelling.fitted(lambda: PipelineModel.load(f"{path}/label")).transform(held).select("o_orderkey", F.round(vector_to_array("probability")[1], 4).alias("p"))
    rate = modelling.run_rates(lambda: PipelineModel.load(f"{path}/runs"), held, ["price", "d"]).select("o_orderkey", F.round("rate", 4).alias("rate"))
    return p.join(rate, "o_orderkey")


@query("j22_simulation")
def simulation(t: Tables) -> DataFrame:
    """Poisson rates and seeded trials per game."""
    m = matrix(t).where("q IS NOT NULL").withColumn("runs", (F.col("q") % 9).cast("double"))
    rates = modelling.fit_run_rates(m, ["price", "d"], "runs")(m)
    games = rates.select(F.col("o_orderkey").alias("game_pk"), F.col("rate").alias("home_rate"), F.greatest(F.col("rate") * 0.9, F.lit(0.05)).alias("away_rate"))
    return modelling.simulate(games, 500)


@query("j06_folds", "SELECT * FROM (VALUES ('expanding', '1992', 1993), ('expanding', '1992,1993', 1994), ('expanding', '1992,1993,1994', 1995), ('rolling 1', '1993', 1994), ('rolling 1', '1994', 1995), ('rolling 2', '1992,1993', 1994), ('rolling 2', '1993,1994', 1995)) v(kind, train, test)")
def folds(t: Tables) -> DataFrame:
    """Chronological folds."""
    s = [1992, 1993, 1994, 1995]
    rows = [("expanding", *f) for f in modelling.expanding_folds(s)] + [(f"rolling {h}", *f) for h in (1, 2) for f in modelling.rolling_folds(s, h, 2)]
    return t.spark.createDataFrame([(k, ",".join(map(str, a)), b) for k, a, b in rows], "kind string, train string, test int")


@query("j27_trial_summary", "SELECT l_suppkey, round((count(*) FILTER (l_discount > l_tax) + 0.5 * count(*) FILTER (l_discount = l_tax)) / count(*), 6) AS p_home, round(avg(l_discount), 6) AS mean_home, round(median(l_discount + l_tax), 6) AS median_total FROM lineitem GROUP BY 1")
def trial_summary(t: Tables) -> DataFrame:
    """Wins plus half of ties, means and exact median."""
    h, a = F.col("l_discount"), F.col("l_tax")
    return t.lineitem.groupBy("l_suppkey").agg(r6((F.count_if(h > a) + 0.5 * F.count_if(h == a)) / F.count(F.lit(1))).alias("p_home"), r6(F.avg(h)).alias("mean_home"), r6(F.median(h + a)).alias("median_total"))


@query("k01_stream_capture", "SELECT count(*) AS stored FROM events WHERE event_type = 'purchase'")
def stream_capture(t: Tables) -> DataFrame:
    """A file stream captured by key; run twice, stored once."""
    source, path = shared_folder(t, "in"), shared_folder(t, "captured")
    rows = t.events.where("event_type = 'purchase'").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.write.parquet(source)
    for n in range(2):
        stream = t.spark.readStream.schema(rows.schema).parquet(source)
        q = capture.capture(capture.keyed(stream, ["event_id"], "ts", "1 day"), path, shared_folder(t, f"progress{n}"), ["event_id"])
        q.awaitTermination(240)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored"))


@query("k03_capture_records", """WITH q AS (SELECT user_id, ts::DATE AS snapshot, max(value) FILTER (event_type = 'click') AS home, max(value) FILTER (event_type = 'purchase') AS away, max(ts) AS predicted FROM events GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY snapshot DESC) AS rn FROM q)
SELECT user_id, home, away, CASE WHEN home IS NULL OR away IS NULL THEN 'one_side_missing' WHEN NOT (snapshot < predicted AND predicted < TIMESTAMP '2024-01-30 00:00:00') THEN 'not_pregame' END AS reason FROM l WHERE rn = 1""")
def capture_records(t: Tables) -> DataFrame:
    """Latest pair per game with a reason where there is none."""
    q = t.events.select("user_id", F.when(F.col("event_type") == "click", "home").when(F.col("event_type") == "purchase", "away").alias("side"), "value", F.to_date("ts").cast("timestamp_ntz").alias("snapshot"), F.col("ts").alias("predicted"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("start"))
    return capture.capture_records(q, "user_id", "side", "value", "snapshot", "predicted", "start").select("user_id", "home", "away", "reason")


@query("k06_board", """WITH v AS (SELECT event_id, user_id, value, ts FROM events WHERE value IS NOT NULL AND props IS NOT NULL), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM v),
r AS (SELECT user_id, count(*) AS results FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT l.user_id, event_id, coalesce(results, 0) AS results FROM l LEFT JOIN r ON r.user_id = l.user_id WHERE rn = 1""")
def board(t: Tables) -> DataFrame:
    """Valid records, latest per key, results attached."""
    v = t.events.where("value IS NOT NULL AND props IS NOT NULL").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    r = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("results"))
    return v.join(r, "user_id", "left").withColumn("results", F.coalesce("results", F.lit(0)))


@query("m24_pending", "SELECT count(*) AS pending FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending(t: Tables) -> DataFrame:
    """Rows not resolved yet."""
    return t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("pending"))
