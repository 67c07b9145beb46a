"""Queries of scalar and vector functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slackframe.functions import fastmath as fm
from slackframe.functions import special as sp
from slackframe.plans import evaluate, mlr
from slackframe.queries.roles import UPDATES, VECTORS, WEIGHTS, long_form, table, unit_sql, updates, vectors, weights

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _points(spark, sf):
    """(id, x, p): positive numbers over several magnitudes, and numbers of either sign."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("value") * F.pow(F.lit(10.0), (F.col("event_id") % 5) - 2)).alias("x"), ((F.col("value") - 20) / 4).alias("p"))


_P = "pts AS (SELECT event_id AS id, value * pow(10.0, event_id % 5 - 2) AS x, (value - 20) / 4 AS p FROM events)"


def _line(x):
    return f"(floor(log2({x})) + 127 + {x} / pow(2.0::DOUBLE, floor(log2({x}))) - 1)"


def _half(x):
    return f"({x} / pow(2.0::DOUBLE, floor(log2({x}))) / 2)"


def s_log2(x):
    return f"({_line(x)} - 124.22551499 - 1.498030302 * {_half(x)} - 1.72587999 / (0.3520887068 + {_half(x)}))"


def s_log(x):
    return f"(0.69314718 * {s_log2(x)})"


def s_rlog2(x):
    return f"({_line(x)} - 126.94269504)"


def s_rlog(x):
    return f"({_line(x)} * 8388608 * 8.2629582881927490e-8 - 87.989971088)"


def _number(line):
    b = f"trunc(8388608 * ({line}))::BIGINT"
    return f"(pow(2.0::DOUBLE, (({b}) >> 23) - 127) * (1 + (({b}) & 8388607) / 8388608.0::DOUBLE))"


def s_pow2(p):
    c = f"greatest({p}, -126.0::DOUBLE)"
    z = f"({c} - trunc({c}) + CASE WHEN {p} < 0 THEN 1.0 ELSE 0.0 END)"
    return _number(f"{c} + 121.2740575 + 27.7280233 / (4.84252568 - {z}) - 1.49012907 * {z}")


def s_exp(x):
    return s_pow2(f"(1.442695040::DOUBLE * ({x}))")


def s_rpow2(p):
    return _number(f"greatest({p}, -126.0::DOUBLE) + 126.94269504")


def s_rexp(x):
    return s_rpow2(f"(1.442695040::DOUBLE * ({x}))")


def _lazy(f, column):
    return lambda: f(F.col(column))


def _pair(name, columns, sqls):
    """A query of several functions over the points."""
    sql = f"WITH {_P} SELECT id, " + ", ".join(f"round({s}, 4) AS {c}" for c, s in sqls.items()) + " FROM pts"

    def run(spark, sf):
        values = _points(spark, sf).select("id", *[f().alias(c) for c, f in columns.items()])
        return values.select("id", *[sp.rounded(F.col(c), 4).alias(c) for c in columns])

    QUERIES[name], ORACLE[name] = run, sql


def _install():
    x, p = "x", "p"
    _pair("ma01", {"log2x": _lazy(fm.fastlog2, x), "lnx": _lazy(fm.fastlog, x)}, {"log2x": s_log2(x), "lnx": s_log(x)})
    _pair("ma02", {"log2x": _lazy(fm.fasterlog2, x), "lnx": _lazy(fm.fasterlog, x)}, {"log2x": s_rlog2(x), "lnx": s_rlog(x)})
    _pair("ma03", {"p2": _lazy(fm.fastpow2, p), "ex": _lazy(fm.fastexp, p)}, {"p2": s_pow2(p), "ex": s_exp(p)})
    _pair("ma04", {"p2": _lazy(fm.fasterpow2, p), "ex": _lazy(fm.fasterexp, p)}, {"p2": s_rpow2(p), "ex": s_rexp(p)})
    _pair("ma05", {"a": lambda: fm.fastpow(F.col(x), 0.7), "b": lambda: fm.fasterpow(F.col(x), 0.7)}, {"a": s_pow2(f"(0.7::DOUBLE * {s_log2(x)})"), "b": s_rpow2(f"(0.7::DOUBLE * {s_rlog2(x)})")})
    _pair("ma06", {"a": _lazy(fm.fastsigmoid, p), "b": _lazy(fm.fastersigmoid, p)}, {"a": f"1 / (1 + {s_exp('-p')})", "b": f"1 / (1 + {s_rexp('-p')})"})
    hyper = {"sinh": "0.5 * ({e1} - {e2})", "cosh": "0.5 * ({e1} + {e2})", "tanh": "-1 + 2 / (1 + {e3})"}
    cols, sqls = {}, {}
    for kind, e in (("fast", s_exp), ("faster", s_rexp)):
        for h, text in hyper.items():
            cols[f"{kind}{h}"] = _lazy(getattr(fm, kind + h), p)
            sqls[f"{kind}{h}"] = text.format(e1=e("p"), e2=e("-p"), e3=e("-2 * p"))
    _pair("ma07", cols, sqls)
    up = "(3 + x)"
    _pair("ma08", {"a": _lazy(fm.fastlgamma, x), "b": _lazy(fm.fasterlgamma, x)}, {
        "a": f"-2.081061466 - x + 0.0833333 / {up} - {s_log('(x * (1 + x) * (2 + x))')} + (2.5 + x) * {s_log(up)}",
        "b": f"-0.0810614667 - x - {s_rlog('x')} + (0.5 + x) * {s_rlog('(1 + x)')}",
    })
    _pair("ma09", {"a": _lazy(fm.fastdigamma, x), "b": _lazy(fm.fasterdigamma, x)}, {
        "a": f"(-48 - 157 * x - 127 * x * x - 30 * x * x * x) / (12 * x * (1 + x) * (2 + x) * (2 + x)) + {s_log('(2 + x)')}",
        "b": f"-1 / x - 1 / (2 * (1 + x)) + {s_rlog('(1 + x)')}",
    })


_install()


@query("ev02", f"WITH {_P} SELECT id, round(lgamma(x), 6) AS g FROM pts")
def ev02(spark, sf):
    return _points(spark, sf).select("id", sp.ln_gamma(F.col("x")).alias("g")).select("id", sp.rounded(F.col("g"), 6).alias("g"))


@query("st06", "SELECT o_orderkey, pow(2, ceil(log2(o_orderkey + 1)))::BIGINT AS n FROM orders")
def st06(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sp.next_power_of_two(F.col("o_orderkey") + 1).alias("n"))


@query("rn01", f"SELECT event_id, round({unit_sql('event_id', 'user_id')}, 9) AS u, floor({unit_sql('event_id', 'user_id')} * 10)::BIGINT AS k FROM events")
def rn01(spark, sf):
    u = sp.unit(F.col("event_id"), F.col("user_id"))
    return table(spark, sf, "events").select("event_id", F.round(u, 9).alias("u"), F.floor(u * 10).alias("k"))


@query("rn02", f"SELECT event_id, round(-ln(1 - {unit_sql('event_id', 'user_id')}) / 2.5, 6) AS e FROM events")
def rn02(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(sp.exponential(sp.unit(F.col("event_id"), F.col("user_id")), 2.5), 6).alias("e"))


def _normal_sql(u: str, v: str) -> str:
    return f"sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v})"


@query("rn02_gamma", f"SELECT vec_id, round(-ln(1 - {unit_sql('vec_id', '0')}) + pow({_normal_sql(unit_sql('vec_id', '1'), unit_sql('vec_id', '2'))}, 2) / 2, 6) AS g FROM embeddings")
def rn02_gamma(spark, sf):
    """Gamma draws of shape 1.5 keyed by id, so that reruns agree."""
    g = sp.gamma_half(3, lambda k: sp.unit(F.col("vec_id"), F.lit(k)))
    return table(spark, sf, "embeddings").select("vec_id", F.round(g, 6).alias("g"))


_HALF = "[" + ", ".join(f"pow({_normal_sql(unit_sql('vec_id', str(k)), unit_sql('vec_id', str(k + 1)))}, 2) / 2" for k in (0, 2, 4, 6)) + "]"


@query("rn03", f"""WITH g AS (SELECT vec_id, {_HALF} AS g FROM embeddings)
  SELECT vec_id, unnest(range(0, 4))::INT AS k, unnest(list_transform(g, lambda v: round(v / list_sum(g), 6))) AS p FROM g""")
def rn03(spark, sf):
    """Symmetric Dirichlet vectors of parameter 1/2: gamma draws over their sum."""
    g = F.array(*[sp.gamma_half(1, lambda j, k=k: sp.unit(F.col("vec_id"), F.lit(k + j))) for k in (0, 2, 4, 6)])
    d = table(spark, sf, "embeddings").select("vec_id", g.alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda a, v: a + v)
    return d.select("vec_id", F.posexplode(F.transform("g", lambda v: F.round(v / total, 6))).alias("k", "p"))


@query("rn04", f"WITH {VECTORS} SELECT id, unnest(range(0, 64))::INT AS k, unnest(list_transform(x, lambda v: round(exp(v - list_max(x)), 6))) AS v FROM vectors")
def rn04(spark, sf):
    return long_form(vectors(spark, sf).select("id", sp.relative_probabilities(F.col("x")).alias("p")), "p")


@query("rn05", f"SELECT vec_id, round(0.1 * {_normal_sql(unit_sql('vec_id', '5'), unit_sql('vec_id', '6'))}, 6) AS v FROM embeddings")
def rn05(spark, sf):
    draw = lambda k: sp.unit(F.col("vec_id"), F.lit(k))
    return table(spark, sf, "embeddings").select("vec_id", F.round(0.1 * sp.normal(draw(5), draw(6)), 6).alias("v"))


@query("hs01", "SELECT ('0x' || md5(concat_ws(',', l_orderkey, l_linenumber))[1:15])::BIGINT % 64 AS bucket, count(*) AS n FROM lineitem GROUP BY ALL")
def hs01(spark, sf):
    """Rows of each bucket of a mixed key."""
    return table(spark, sf, "lineitem").groupBy((sp.key_mix(F.col("l_orderkey"), F.col("l_linenumber")) % 64).alias("bucket")).agg(F.count("*").alias("n"))


@query("lr02", f"""WITH {VECTORS}, {WEIGHTS} SELECT id, w.label AS of_label, round(list_dot_product(x, w::DOUBLE[]), 6) AS score
  FROM vectors v, weights w""")
def lr02(spark, sf):
    s = mlr.scored(vectors(spark, sf), weights(spark))
    return s.select("id", F.posexplode("scores").alias("of_label", "score")).select("id", "of_label", F.round("score", 6).alias("score"))


@query("lr03", f"WITH {VECTORS} SELECT id, unnest(range(0, 64))::INT AS k, unnest(list_transform(x, lambda v, i: round(x[65 - i] + 0.5 * v, 6))) AS v FROM vectors")
def lr03(spark, sf):
    return long_form(vectors(spark, sf).select("id", sp.axpy(0.5, F.col("x"), F.reverse("x")).alias("y")), "y")


_SOFT = f"""{VECTORS}, {WEIGHTS}, sc AS (SELECT id, v.label, w.label AS l, list_dot_product(x, w::DOUBLE[]) AS s FROM vectors v, weights w),
 rs AS (SELECT id, label, l, CASE WHEN abs(s) < 1e-15 THEN 1e-15 ELSE s END AS s FROM sc),
 pr AS (SELECT id, label, l, least(1.0, exp(s - (max(s) OVER w + ln(sum(exp(s)) OVER w / exp(max(s) OVER w))))) AS p FROM rs WINDOW w AS (PARTITION BY id))"""


@query("lr04", f"WITH {_SOFT} SELECT id, l, round(p, 6) AS p FROM pr")
def lr04(spark, sf):
    rows = mlr.predicted(vectors(spark, sf), weights(spark)).select("id", F.posexplode("p").alias("l", "p"))
    return rows.select("id", "l", F.round("p", 6).alias("p"))


@query("lr05", f"WITH {_SOFT} SELECT id, arg_max(l, p * 1e6 - l * 1e-9) AS said, round(max(p), 6) AS p FROM pr GROUP BY id")
def lr05(spark, sf):
    rows = mlr.judged(mlr.predicted(vectors(spark, sf), weights(spark)))
    return rows.select("id", "said", F.round(F.array_max("p"), 6).alias("p"))


@query("lr07", "SELECT c::INT AS clock, round(0.4 * pow(0.95, c), 9) AS rate FROM range(20) t(c)")
def lr07(spark, sf):
    return spark.range(20).select(F.col("id").cast("int").alias("clock"), F.round(mlr.learning_rate(F.lit(0.4), 0.95, F.col("id")), 9).alias("rate"))


@query("lr08", f"""WITH {_SOFT} SELECT id, any_value(label) AS label, (arg_max(l, p * 1e6 - l * 1e-9) <> any_value(label))::INT AS zero_one FROM pr GROUP BY id""")
def lr08(spark, sf):
    return mlr.judged(mlr.predicted(vectors(spark, sf), weights(spark))).select("id", "label", "zero_one")


@query("lr09", f"WITH {_SOFT} SELECT id, round(ln(greatest(p, 1e-15)), 6) AS log_likelihood FROM pr WHERE l = label")
def lr09(spark, sf):
    return mlr.judged(mlr.predicted(vectors(spark, sf), weights(spark))).select("id", F.round("log_likelihood", 6).alias("log_likelihood"))


@query("ev03", f"""WITH {_SOFT}, j AS (SELECT id, (arg_max(l, p * 1e6 - l * 1e-9) <> any_value(label))::INT AS e FROM pr GROUP BY id)
  SELECT round(avg(e), 6) AS objective, count(*) AS n FROM j""")
def ev03(spark, sf):
    return mlr.judged(mlr.predicted(vectors(spark, sf), weights(spark))).agg(F.round(F.avg("zero_one"), 6).alias("objective"), F.count("*").alias("n"))


_DELTAS = f"""{_SOFT}, dl AS (SELECT p.l AS label, (k.i - 1)::INT AS k, sum(-0.1 * (p.p - (p.l = p.label)::INT) * v.x[k.i]) AS value
  FROM pr p JOIN vectors v USING (id), (SELECT unnest(range(1, 65)) AS i) k GROUP BY ALL)"""


@query("lr01", f"WITH {_DELTAS}, o AS (SELECT label, unnest(w)::DOUBLE AS w, unnest(range(0, 64))::INT AS k FROM weights) SELECT label, k, round(w + value, 6) AS w FROM o JOIN dl USING (label, k)")
def lr01(spark, sf):
    w = weights(spark)
    d = mlr.batch_deltas(mlr.predicted(vectors(spark, sf), w), 0.1)
    old = w.select("label", F.posexplode("w").alias("k", "w"))
    return old.join(d, ["label", "k"]).select("label", "k", F.round(F.col("w") + F.col("value"), 6).alias("w"))


@query("lr06_batch", f"WITH {_DELTAS} SELECT label, k, round(value, 6) AS value FROM dl")
def lr06_batch(spark, sf):
    return mlr.batch_deltas(mlr.predicted(vectors(spark, sf), weights(spark)), 0.1).select("label", "k", F.round("value", 6).alias("value"))


_SGD = f"""{VECTORS}, {WEIGHTS}, ex AS (SELECT id % 8 AS worker, x, label, row_number() OVER (PARTITION BY id % 8 ORDER BY id) AS nth FROM vectors),
 w0 AS (SELECT list(w::DOUBLE[] ORDER BY label) AS w FROM weights),
 fold AS (SELECT worker, 0::BIGINT AS nth, w FROM (SELECT DISTINCT worker FROM ex), w0 UNION ALL
  SELECT worker, nth, list_transform(w, lambda r, l: list_transform(r, lambda v, k: v - 0.1 * (p[l] - (l - 1 = label)::INT) * x[k]))
  FROM (SELECT worker, nth, w, x, label, list_transform(e, lambda v: v / list_sum(e)) AS p
    FROM (SELECT worker, nth, w, x, label, list_transform(s, lambda v: exp(v - list_max(s))) AS e
      FROM (SELECT f.worker, ex.nth, f.w, ex.x, ex.label, list_transform(f.w, lambda r: list_dot_product(r, ex.x)) AS s
        FROM fold f JOIN ex ON ex.worker = f.worker AND ex.nth = f.nth + 1)))),
 last AS (SELECT worker, arg_max(w, nth) AS w FROM fold GROUP BY worker), per AS (SELECT worker, unnest(range(0, 10))::INT AS label, unnest(w) AS r FROM last)"""


@query("lr06", f"""WITH RECURSIVE {_SGD}, c AS (SELECT worker, label, unnest(range(0, 64))::INT AS k, unnest(r) AS v FROM per)
  SELECT worker, c.label, k, round(v - weights.w[k + 1], 6) + 0.0 AS v FROM c JOIN weights ON weights.label = c.label""")
def lr06(spark, sf):
    d = long_form(mlr.sgd_epoch(vectors(spark, sf), weights(spark), F.col("id") % 8, 0.1), "delta")
    return d.withColumn("v", F.col("v") + 0.0)


@query("lr10", f"WITH {_DELTAS} SELECT round(sum(value), 6) AS total_change FROM dl")
def lr10(spark, sf):
    t = mlr.total_change(mlr.batch_deltas(mlr.predicted(vectors(spark, sf), weights(spark)), 0.1))
    return t.select(F.round("total_change", 6).alias("total_change"))


@query("st05", f"""WITH {UPDATES}, d AS (SELECT rid, clock, count(*) AS n FROM updates GROUP BY ALL),
  s AS (SELECT rid AS id, row_number() OVER (PARTITION BY rid ORDER BY clock) - 1 AS pos, sum(n) OVER (PARTITION BY rid ORDER BY clock ROWS UNBOUNDED PRECEDING) AS v FROM d),
  b AS (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY pos) AS b, first_value(v) OVER w AS f, last_value(v) OVER w AS l FROM s
        WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  c AS (SELECT id, min_by(pos - 1 + (100.5 - b) / (v - b), pos) FILTER (v > 100.5 AND f < 100.5 AND l > 100.5) AS x FROM b GROUP BY id)
  SELECT id, round(coalesce(x, -1), 6) AS crossing FROM c""")
def st05(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("rid").orderBy("clock")
    d = updates(spark, sf).groupBy("rid", "clock").agg(F.count("*").alias("n"))
    s = d.select(F.col("rid").alias("id"), (F.row_number().over(w) - 1).alias("at"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("value"), F.lit(100.5).alias("target"))
    c = evaluate.crossings(s)
    return c.select("id", F.round(F.when(F.isnan("crossing"), -1.0).otherwise(F.col("crossing")), 6).alias("crossing"))
