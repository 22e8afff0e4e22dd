"""Boards, scores, hashes, graphs, themes and barycentres on the test tables, with their oracles.

Boards are made from lineitem keys by arithmetic that both engines share; they need not be legal positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import board, hashing, score
from ..functions.core import let
from ..operators import barycentric, graph, themes, windows
from ..sources.readers import spread
from .catalog import query, table
from .relational import r6


def _slots(first, second, third, times: tuple[int, int, int, int]) -> Column:
    """26 slots of 0..3."""
    a, b, c, e = times
    values = (F.pmod(first * (i * i * a + b) + second * (i + c) + third * e, F.lit(11)) for i in range(26))
    return F.array(*(F.when(v <= 3, v).otherwise(0).cast("int") for v in values))


def _slots_sql(first: str, second: str, third: str, times: tuple[int, int, int, int]) -> str:
    a, b, c, e = times
    v = f"(({first} * (i * i * {a} + {b}) + {second} * (i + {c}) + {third} * {e}) % 11)"
    return f"list_transform(range(0, 26), lambda i: CASE WHEN {v} <= 3 THEN {v} ELSE 0 END)"


ONE, TWO = (1, 7, 3, 0), (0, 3, 5, 1)


def positions(spark: SparkSession, d: str) -> DataFrame:
    li = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag"))
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        k.alias("game_id"), F.col("l_linenumber").alias("move_number"), p.alias("part"), s.alias("supp"), "l_discount", "l_returnflag",
        _slots(k, p, s, ONE).alias("b"), _slots(p, s, k, TWO).alias("c"), F.array(1 + F.pmod(k, F.lit(6)), 1 + F.pmod(p, F.lit(6))).alias("dice"),
    )


POSITIONS = f"""(SELECT l_orderkey AS game_id, l_linenumber AS move_number, l_partkey AS part, l_suppkey AS supp, l_discount, l_returnflag,
{_slots_sql("l_orderkey", "l_partkey", "l_suppkey", ONE)} AS b, {_slots_sql("l_partkey", "l_suppkey", "l_orderkey", TWO)} AS c,
[1 + l_orderkey % 6, 1 + l_partkey % 6] AS dice FROM lineitem)"""

KEY = ["game_id", "move_number", "part", "supp"]
KEYS = ", ".join(KEY)


def _bits(slots: str, holds: str) -> str:
    return f"array_to_string(list_transform({slots}, lambda x: CASE WHEN x {holds} THEN '1' ELSE '0' END), '')"


def _run(text: str) -> str:
    return f"list_max(list_transform(string_split({text}, '0'), lambda t: length(t)))"


_PIP = "(list_sum(list_transform(range(1, 25), lambda i: {0}[i + 1] * i)) + {0}[1] * 25)::BIGINT"
_BACK = "coalesce(list_max(list_filter(range(1, 25), lambda i: {0}[i + 1] > 0)), 0)"


@query(f"""SELECT {KEYS}, {_PIP.format("b")} AS pip, {_PIP.format("c")} AS pip2, len(list_filter(b[2:25], lambda x: x = 1)) AS blots, len(list_filter(b[8:19], lambda x: x = 1)) AS outfield_blots,
len(list_filter(b[2:25], lambda x: x >= 2)) AS made, list_sum(list_transform(range(1, 7), lambda i: CASE WHEN b[i + 1] >= 2 THEN i ELSE 0 END))::BIGINT AS strength,
list_sum(b[20:25])::BIGINT AS back FROM {POSITIONS}""")
def board_counts(spark: SparkSession, d: str) -> DataFrame:
    b, c = F.col("b"), F.col("c")
    cols = {"pip": board.pip_count(b), "pip2": board.pip_count(c), "blots": board.blots(b), "outfield_blots": board.blots(b, 7, 18), "made": board.made_points(b), "strength": board.home_strength(b), "back": board.checkers(b, 19, 24)}
    return positions(spark, d).select(*KEY, *(v.cast("long").alias(k) for k, v in cols.items()))


@query(f"""SELECT {KEYS}, prime, CASE WHEN prime >= 2 THEN instr(bits, repeat('1', prime::INT)) ELSE 0 END AS at, coalesce(list_max(list_filter(range(19, 25), lambda i: b[i + 1] >= 2)), 0) AS anchor,
len(list_filter(range(1, 25), lambda i: b[i + 1] = 1 AND ((i > 1 AND b[i] < 2) OR (i < 24 AND b[i + 2] < 2)))) AS builders,
CASE WHEN back <= 7 THEN 0 ELSE {_run(_bits("b[8:back + 1]", "= 0"))} END AS gap
FROM (SELECT *, {_run("bits")} AS prime FROM (SELECT *, {_bits("b[2:25]", ">= 2")} AS bits, {_BACK.format("b")} AS back FROM {POSITIONS}))""")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    """Primes, their places, anchors, builders and gaps."""
    b = F.col("b")
    cols = {"prime": board.longest_prime(b), "at": board.prime_location(b), "anchor": board.back_anchor(b), "builders": board.builders(b), "gap": board.max_gap(b)}
    return positions(spark, d).select(*KEY, *(v.cast("long").alias(k) for k, v in cols.items()))


_STANDS, _FREE = "({0} <= 24 AND b[{0} + 1] > 0)", "({0} <= 24 AND c[26 - ({0})] < 2)"


def _hit_sql() -> str:
    s, f = _STANDS.format, _FREE.format
    lo, hi = "dice[1]", "dice[2]"
    direct = f"{s(f'(y + {lo})')} OR {s(f'(y + {hi})')}"
    both = f"({lo} <> {hi} AND {s(f'(y + {lo} + {hi})')} AND ({f(f'(y + {lo})')} OR {f(f'(y + {hi})')}))"
    steps = [f"({lo} = {hi} AND " + " AND ".join([s(f"(y + {k} * {lo})"), *(f(f"(y + {m} * {lo})") for m in range(1, k))]) + ")" for k in (2, 3, 4)]
    return " OR ".join([direct, both, *steps])


@query(f"""SELECT {KEYS}, CASE WHEN b[1] > 0 THEN len(list_filter(t, lambda y: y = 25 - dice[1] OR y = 25 - dice[2])) > 0 ELSE len(list_filter(t, lambda y: {_hit_sql()})) > 0 END AS can_hit,
CASE WHEN out1 = 0 AND b[1] = 0 AND out2 = 0 AND c[1] = 0 THEN 2 WHEN b[1] > 0 OR c[1] > 0 OR back1 + back2 > 24 THEN 0 ELSE 1 END AS phase,
greatest(dice[1], dice[2]) || '-' || least(dice[1], dice[2]) AS label, CASE WHEN dice[1] = dice[2] THEN dice[1] * 4 ELSE dice[1] + dice[2] END AS pips
FROM (SELECT *, list_filter(range(1, 25), lambda y: c[26 - y] = 1) AS t, list_sum(b[8:25]) AS out1, list_sum(c[8:25]) AS out2, {_BACK.format("b")} AS back1, {_BACK.format("c")} AS back2 FROM {POSITIONS})""")
def dice_label(spark: SparkSession, d: str) -> DataFrame:
    """Rolls: labels, pips, whether a blot can be hit, and the phase."""
    b, c, dice = F.col("b"), F.col("c"), F.col("dice")
    return positions(spark, d).select(*KEY, board.can_hit(b, c, dice).alias("can_hit"), board.phase(b, c).alias("phase"), board.dice_label(dice).alias("label"), board.dice_pips(dice).alias("pips"))


_MADE = "list_filter(range(0, 24), lambda i: {0} * s[i + 1] >= 2)"
_SIGNED = f"(SELECT *, list_transform(range(0, 24), lambda i: b[i + 2] - c[25 - i]) AS s FROM {POSITIONS})"


def _run_of_points(points: str) -> str:
    return _run(f"array_to_string(list_transform(range(0, 24), lambda i: CASE WHEN list_contains({points}, i) THEN '1' ELSE '0' END), '')")


@query(f"""WITH p AS (SELECT {KEYS}, s, b[1] AS bx, c[1] AS bo, {_MADE.format(1)} AS mx, {_MADE.format(-1)} AS mo, list_filter(range(0, 24), lambda i: s[i + 1] > 0) AS px, list_filter(range(0, 24), lambda i: s[i + 1] < 0) AS po FROM {_SIGNED}),
q AS (SELECT *, CASE WHEN bx > 0 THEN 24 ELSE coalesce(list_max(px), -1) END AS hx, CASE WHEN bo > 0 THEN -1 ELSE coalesce(list_min(po), 24) END AS lo FROM p)
SELECT {KEYS}, len(list_filter(s, lambda x: x = 1)) AS blot_x, len(list_filter(s, lambda x: x = -1)) AS blot_o, len(mx) AS made_x, len(mo) AS made_o, {_run_of_points("mx")} AS prime_x, {_run_of_points("mo")} AS prime_o,
len(list_filter(mx, lambda i: i >= 18)) AS anchor_x, len(list_filter(mo, lambda i: i <= 5)) AS anchor_o,
(list_sum(list_transform(range(0, 24), lambda i: greatest(s[i + 1], 0) * (i + 1))) + bx * 25 - list_sum(list_transform(range(0, 24), lambda i: greatest(-s[i + 1], 0) * (24 - i))) - bo * 25)::BIGINT AS pip_diff,
CASE WHEN hx >= lo AND hx >= 0 AND lo < 24 THEN 0 WHEN bx = 0 AND bo = 0 AND len(list_filter(px, lambda i: i > 5)) = 0 AND len(list_filter(po, lambda i: i < 18)) = 0 THEN 2 ELSE 1 END AS pos_class FROM q""")
def popcount_masks(spark: SparkSession, d: str) -> DataFrame:
    """The derived features of signed boards by bit masks and bit counts."""
    f = board.derived_features(F.col("s"), F.col("b")[0], F.col("c")[0])
    out = positions(spark, d).withColumn("s", board.display(F.col("b"), F.col("c"))).select(*KEY, f.alias("f"))
    return out.select(*KEY, *(F.col(f"f.{c}").cast("long").alias(c) for c in ("blot_x", "blot_o", "made_x", "made_o", "prime_x", "prime_o", "anchor_x", "anchor_o", "pip_diff", "pos_class")))


_RAW_SQL = {"bar_x": "b[1]", "bar_o": "c[1]", "off_x": "b[26]", "off_o": "c[26]", "pip_x": "list_sum(list_transform(range(0, 24), lambda i: greatest(s[i + 1], 0) * (i + 1))) + b[1] * 25",
"pip_o": "list_sum(list_transform(range(0, 24), lambda i: greatest(-s[i + 1], 0) * (24 - i))) + c[1] * 25", "cube_log2": "move_number % 4", "cube_owner": "move_number % 3", "away_x": "part % 15", "away_o": "supp % 15"}


@query(f"""SELECT {KEYS}, {", ".join(f"s[{i + 1}]::DOUBLE AS p{i}" for i in range(24))}, {", ".join(f"({x})::DOUBLE AS {k}" for k, x in _RAW_SQL.items())} FROM {_SIGNED}""")
def raw_features(spark: SparkSession, d: str) -> DataFrame:
    """The 34 raw features of signed boards."""
    b, c, m = F.col("b"), F.col("c"), F.col("move_number")
    p = positions(spark, d).withColumn("s", board.display(b, c))
    f = board.raw_features(F.col("s"), b[0], c[0], b[25], c[25], m % 4, m % 3, F.col("part") % 15, F.col("supp") % 15)
    return p.select(*KEY, f.alias("f")).select(*KEY, *(F.col("f")[i].alias(n) for i, n in enumerate([*(f"p{i}" for i in range(24)), *board.RAW])))


@query("""SELECT l_orderkey, l_linenumber, round((l_discount::DOUBLE - l_tax::DOUBLE) * 10000)::INT AS scaled, round((l_discount::DOUBLE - l_tax::DOUBLE) * 10000)::INT / 10000.0::DOUBLE AS equity FROM lineitem""")
def equity_scale(spark: SparkSession, d: str) -> DataFrame:
    """Equities as stored integers, and back."""
    scaled = score.equity_scaled(F.col("l_discount").cast("double") - F.col("l_tax").cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scaled.alias("scaled"), score.equity_of(scaled).alias("equity"))


def _xor_sql(items: str) -> str:
    return f"list_reduce({items}, lambda a, x: xor(a, x), 0::BIGINT)"


def _zobrist_sql() -> str:
    k = hashing.zobrist_keys()
    lit = lambda xs: "[" + ", ".join(f"({x})::BIGINT" if x > -(2**63) else "(-9223372036854775807 - 1)" for x in xs) + "]"
    parts = [_xor_sql(f"list_transform(range(0, 24), lambda i: CASE WHEN {sign} * s[i + 1] > {level} THEN {lit(k[name][level])}[i + 1] ELSE 0 END)") for sign, name in ((1, "x"), (-1, "o")) for level in range(4)]
    flat = lit([x for row in k["count"] for x in row])
    parts.append(_xor_sql(f"list_transform(range(0, 24), lambda i: {flat}[i * 16 + abs(s[i + 1]) + 1])"))
    parts += [f"{lit(k['bar_x'])}[b[1] + 1]", f"{lit(k['bar_o'])}[c[1] + 1]", f"{lit(k['off_x'])}[b[26] + 1]", f"{lit(k['off_o'])}[c[26] + 1]"]
    out = parts[0]
    for x in parts[1:]:
        out = f"xor({out}, {x})"
    return out


@query(f"""SELECT {KEYS}, h AS board_hash, xor(xor(h, CASE WHEN move_number % 2 = 0 THEN ({hashing.zobrist_keys()["side"][0]})::BIGINT ELSE ({hashing.zobrist_keys()["side"][1]})::BIGINT END),
xor(xor(({hashing.zobrist_keys()["cube"][0]})::BIGINT, ({hashing.zobrist_keys()["owner"][0]})::BIGINT), xor(({hashing.zobrist_keys()["away_x"][7]})::BIGINT, ({hashing.zobrist_keys()["away_o"][5]})::BIGINT))) AS full_hash
FROM (SELECT {KEYS}, {_zobrist_sql()} AS h FROM {_SIGNED})""")
def zobrist_hash(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d).withColumn("s", board.display(F.col("b"), F.col("c")))
    h = hashing.board_hash(F.col("s"), F.col("b")[0], F.col("c")[0], F.col("b")[25], F.col("c")[25])
    full = let(h, lambda x: F.struct(x.alias("h"), hashing.context_hash(x, F.pmod("move_number", F.lit(2)), F.lit(0), F.lit(0), F.lit(7), F.lit(5)).alias("f")))
    return p.select(*KEY, full.alias("x")).select(*KEY, F.col("x.h").alias("board_hash"), F.col("x.f").alias("full_hash"))


@query(None)
def packed_hash(spark: SparkSession, d: str) -> DataFrame:
    """Position identities and how often each occurs, in bands. Checked in the tests: SQL has no xxh64."""
    p = positions(spark, d)
    one, k = F.lit(1), F.pmod("move_number", F.lit(4)).cast("int")
    h = p.select(hashing.packed_hash(F.col("b"), k, F.lit(0) * k, one * k, one * k).alias("h"))
    n = h.groupBy("h").agg(F.count("*").alias("n"))
    return n.groupBy(hashing.occurrence_band(F.col("n")).alias("band")).agg(F.count("*").alias("positions"), F.sum("n").alias("occurrences"))


@query("""SELECT o_orderkey, substring(sha256(lower(trim(c_name)) || '|' || lower(trim(c_mktsegment)) || '|' || o_orderkey), 1, 16) AS match_id FROM orders JOIN customer ON o_custkey = c_custkey""")
def sha_id(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    return j.select("o_orderkey", hashing.text_id(F.col("c_name"), F.col("c_mktsegment"), F.col("o_orderkey")).alias("match_id"))


@query("""SELECT o_orderkey, sha256(least(lower(c_name), lower(n_name)) || '|' || greatest(lower(c_name), lower(n_name)) || '|' || coalesce(d, '')) AS h FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, array_to_string(list_transform(list_sort(list([l_partkey, l_suppkey]))[1:10], lambda x: least(1 + x[1] % 6, 1 + x[2] % 6) || '' || greatest(1 + x[1] % 6, 1 + x[2] % 6)), '|') AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def canonical_match_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash of ordered names and the first ten sorted rolls, alike whatever side a record was kept from."""
    rolls = F.transform(F.array_sort(F.collect_list(F.array("l_partkey", "l_suppkey"))), lambda x: F.array(1 + x[0] % 6, 1 + x[1] % 6))
    dice = table(spark, d, "lineitem").groupBy("l_orderkey").agg(hashing.digits(rolls).alias("dice"))
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.expr("c_nationkey = n_nationkey"))
    j = j.join(dice, F.expr("l_orderkey = o_orderkey"), "left")
    names = hashing.canonical_names(F.col("c_name"), F.col("n_name"))
    return j.select("o_orderkey", F.sha2(F.concat_ws("|", names, F.coalesce("dice", F.lit(""))), 256).alias("h"))


# --- scores


_AWAY = "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, 1 + l_partkey % 13 AS a, 1 + l_suppkey % 11 AS b, l_linenumber = 3 AS craw FROM lineitem)"


def aways(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", (1 + F.pmod("l_partkey", F.lit(13))).alias("a"), (1 + F.pmod("l_suppkey", F.lit(11))).alias("b"), (F.col("l_linenumber") == 3).alias("craw"))


@query(f"""SELECT 'a' || a || '_b' || b || '_' || v AS cell, a || 'a-' || b || 'a' || CASE v WHEN 'crawford' THEN ' CRA' WHEN 'post_crawford' THEN ' PCR' ELSE '' END AS label, count(*) AS n,
round(avg(l_discount), 6) AS mean_x, round(stddev_samp(l_tax), 6) AS std_y, round(covar_pop(l_discount, l_tax), 12) AS covariance
FROM (SELECT *, CASE WHEN craw THEN 'crawford' WHEN a = 1 OR b = 1 THEN 'post_crawford' ELSE 'normal' END AS v FROM {_AWAY}) GROUP BY 1, 2""")
def label_format(spark: SparkSession, d: str) -> DataFrame:
    """Score cells: ids, labels and statistics."""
    v = score.variant(F.col("a"), F.col("b"), F.col("craw"))
    rows = aways(spark, d).withColumn("v", v).withColumns({"cell": score.cell_id(F.col("a"), F.col("b"), F.col("v")), "label": score.cell_label(F.col("a"), F.col("b"), F.col("v"))})
    out = barycentric.cell_statistics(rows, ["cell", "label"], "l_discount", "l_tax")
    return out.select("cell", "label", "n", r6("mean_x").alias("mean_x"), r6("std_y").alias("std_y"), F.round("covariance", 12).alias("covariance"))


_TP = "least(greatest((0.5 + 0.425 * (b - a) / (b + a) - {l}) / greatest({w} - {l}, 1e-6), 0), 0.5)".format(
    w="(0.5 + 0.425 * (b - (a - 1)) / (b + greatest(a - 1, 1)))", l="(0.5 + 0.425 * ((b - 1) - a) / (greatest(b - 1, 1) + a))"
)


@query(f"""SELECT a, b, count(*) AS n, round(any_value({_TP.replace("0.425", "0.425::DOUBLE")}), 6) AS take_point, any_value(CASE WHEN a < b THEN 1 WHEN b < a THEN 2 ELSE 0 END) AS leader,
any_value(CASE WHEN a = 1 AND b = 1 THEN 'dmp' WHEN a <= 3 AND b <= 3 THEN 'both_near' WHEN a <= 3 THEN 'ahead' WHEN b <= 3 THEN 'behind' ELSE 'far' END) AS zone FROM {_AWAY} GROUP BY 1, 2""")
def take_points(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    g = aways(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))
    return g.select("a", "b", "n", r6(score.take_point(a, b)).alias("take_point"), score.leader(a, b).alias("leader"), score.zone(a, b).alias("zone"))


@query("""SELECT event_id, round(greatest(0, greatest(nd, least(dt, dp)) - value), 6) AS error, cat FROM (SELECT event_id, value, user_id % 90 * 1.0::DOUBLE AS nd, user_id % 70 * 1.5::DOUBLE AS dt, user_id % 50 * 2.0::DOUBLE AS dp,
CASE WHEN event_type = 'click' THEN 'no_double' WHEN event_type = 'view' THEN 'double_pass' WHEN event_type = 'purchase' THEN 'double_take' ELSE 'double' END AS cat FROM events)""")
def cube_errors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    m = lambda k, x: F.pmod("user_id", F.lit(k)) * F.lit(x)
    action = F.when(F.col("event_type") == "click", "No Double").when(F.col("event_type") == "view", "Double/Pass").when(F.col("event_type") == "purchase", "Double/Take").otherwise("Double")
    return e.select("event_id", r6(score.cube_error(m(90, 1.0), m(70, 1.5), m(50, 2.0), F.col("value"))).alias("error"), score.cube_category(action).alias("cat"))


# --- graph


_EDGES = "(SELECT * FROM (SELECT user_id, event_type AS from_node, lead(event_type) OVER w AS to_node, value, (user_id + event_id) % 9 AS move FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE to_node IS NOT NULL)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("move", F.expr("(user_id + event_id) % 9"))
    return windows.transitions(e, ["user_id"], ["ts", "event_id"], "event_type", ["value", "move"])


@query(f"""WITH e AS {_EDGES}, a AS (SELECT from_node, to_node, count(*) AS n, avg(coalesce(value, 0)) AS m FROM e GROUP BY 1, 2),
t AS (SELECT from_node, to_node, move FROM (SELECT *, row_number() OVER (PARTITION BY from_node, to_node ORDER BY c DESC, move) AS r FROM (SELECT from_node, to_node, move, count(*) AS c FROM e GROUP BY 1, 2, 3)) WHERE r = 1)
SELECT from_node, to_node, n, round(m, 6) AS avg_error, move AS top_move, round(n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY from_node), 6) AS share FROM a JOIN t USING (from_node, to_node)""")
def edge_agg(spark: SparkSession, d: str) -> DataFrame:
    out = graph.aggregated_edges(edges(spark, d), "move", "value")
    return out.select("from_node", "to_node", "n", r6("avg_error").alias("avg_error"), "top_move", r6("share").alias("share"))


@query(f"""WITH e AS {_EDGES}, o AS (SELECT from_node AS node, count(*) AS n_out, count(DISTINCT to_node) AS out_degree, avg(value) AS m FROM e GROUP BY 1), i AS (SELECT to_node AS node, count(*) AS n_in, count(DISTINCT from_node) AS in_degree FROM e GROUP BY 1),
h AS (SELECT node, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM (SELECT from_node AS node, move, count(*) AS c FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT node, n_out, out_degree, round(m, 6) AS avg_error, n_in, in_degree, round(entropy, 6) AS entropy FROM o FULL JOIN i USING (node) LEFT JOIN h USING (node)""")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    out = graph.nodes(edges(spark, d), "move", "value")
    return out.select("node", "n_out", "out_degree", r6("avg_error").alias("avg_error"), "n_in", "in_degree", r6("entropy").alias("entropy"))


_WALK = "(SELECT user_id, from_node, to_node FROM (SELECT user_id, CAST(floor(value) AS INT) AS from_node, CAST(floor(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS INT) AS to_node FROM events) WHERE to_node IS NOT NULL)"


def walk(spark: SparkSession, d: str) -> DataFrame:
    """Edges between many nodes: the integer part of an event's value."""
    e = table(spark, d, "events").withColumn("node", F.floor("value").cast("int"))
    return windows.transitions(e, ["user_id"], ["ts", "event_id"], "node")


@query(f"""WITH e AS {_WALK}, n AS (SELECT coalesce(o.node, i.node) AS node, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM (SELECT from_node AS node, count(*) AS n_out FROM e GROUP BY 1) o FULL JOIN (SELECT to_node AS node, count(*) AS n_in FROM e GROUP BY 1) i ON o.node = i.node)
SELECT node, n_in, n_out, round(n_in * 1.0::DOUBLE / greatest(n_out, 1), 6) AS ratio FROM n ORDER BY n_in * 1.0::DOUBLE / greatest(n_out, 1) DESC, node LIMIT 20""")
def attractors(spark: SparkSession, d: str) -> DataFrame:
    e = walk(spark, d).withColumns({"move": F.col("to_node"), "err": F.lit(0.0)})
    return graph.attractors(graph.nodes(e, "move", "err"), 20).select("node", "n_in", "n_out", r6("ratio").alias("ratio"))


@query(f"SELECT from_node AS node, count(DISTINCT user_id) AS n_matches, count(*) AS n FROM {_WALK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def crossroads(spark: SparkSession, d: str) -> DataFrame:
    return graph.crossroads(walk(spark, d), "user_id", 25)


@query(f"""WITH e AS {_WALK}, a AS (SELECT from_node, to_node, count(*) AS n FROM e GROUP BY 1, 2), s AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY from_node) AS share FROM a)
SELECT from_node, count(*) AS moves, sum(CASE WHEN share >= 0.2 THEN n ELSE 0 END)::BIGINT AS highway, sum(CASE WHEN share >= 0.2 THEN 0 ELSE n END)::BIGINT AS trail FROM s GROUP BY 1""")
def highways(spark: SparkSession, d: str) -> DataFrame:
    e = walk(spark, d).withColumns({"move": F.col("to_node"), "err": F.lit(0.0)})
    return graph.highways(graph.aggregated_edges(e, "move", "err"), 0.2)


@query(f"""WITH e AS {_WALK}, d AS (SELECT 'out' AS kind, count(DISTINCT to_node) AS degree FROM e GROUP BY from_node UNION ALL SELECT 'in', count(DISTINCT from_node) FROM e GROUP BY to_node),
lone AS (SELECT 'out' AS kind, 0 AS degree FROM (SELECT DISTINCT to_node FROM e WHERE to_node NOT IN (SELECT from_node FROM e)) UNION ALL SELECT 'in', 0 FROM (SELECT DISTINCT from_node FROM e WHERE from_node NOT IN (SELECT to_node FROM e)))
SELECT kind, degree, count(*) AS n FROM (SELECT * FROM d UNION ALL SELECT * FROM lone) GROUP BY 1, 2""")
def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    e = walk(spark, d).withColumns({"move": F.col("to_node"), "err": F.lit(0.0)})
    return graph.degree_distribution(graph.nodes(e, "move", "err"))


@query("""WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS path FROM events GROUP BY 1) SELECT user_id, len(path) AS n, list_position(path, 'purchase') AS at FROM s WHERE list_contains(path, 'purchase')""")
def trajectories_through(spark: SparkSession, d: str) -> DataFrame:
    s = windows.ordered_lists(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return graph.through(s, "purchase").select("user_id", F.size("sequence").cast("long").alias("n"), "at")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """All edges of the walks."""
    return walk(spark, d).groupBy("from_node", "to_node").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE e AS (SELECT from_node AS a, to_node AS b FROM {_WALK} UNION SELECT to_node, from_node FROM {_WALK}),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, min(b) AS component FROM r GROUP BY 1""")
def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(steps(spark, d))


@query(None)
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Checked against brute force in the tests."""
    return graph.betweenness(walk(spark, d))


@query(None)
def communities(spark: SparkSession, d: str) -> DataFrame:
    """Checked on planted groups in the tests."""
    return graph.communities(steps(spark, d))


# --- themes and barycentres


def theme_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every column that the theme registry reads, from boards and key arithmetic."""
    b, c = F.col("b"), F.col("c")
    p = positions(spark, d)
    figures = {"match_phase": board.phase(b, c), "board_p1": b, "board_p2": c, "num_builders_p1": board.builders(b), "back_anchor_p1": board.back_anchor(b), "max_gap_p1": board.max_gap(b), "can_hit_p1": board.can_hit(b, c, F.col("dice")), "outfield_blots_p1": board.blots(b, 7, 18), "anchors_back_p1": board.made_points(b, 20, 24), "ace_anchor_only_p1": (b[24] >= 2) & (board.made_points(b, 19, 23) == 0)}
    for x, s in ((b, "p1"), (c, "p2")):
        figures |= {f"pip_{s}": board.pip_count(x), f"bar_{s}": x[0], f"off_{s}": x[25], f"blots_{s}": board.blots(x), f"made_{s}": board.made_points(x), f"prime_{s}": board.longest_prime(x), f"home_{s}": board.made_points(x, 1, 6), f"back_{s}": board.checkers(x, 19, 24)}
    m = lambda k, of="part": F.pmod(of, F.lit(k)) / F.lit(float(k))
    figures |= {"decision_type": F.when(F.pmod("part", F.lit(2)) == 0, "checker").otherwise("cube"), "cube_action_optimal": F.element_at(F.array(*map(F.lit, ("No Double", "Double/Take", "Double/Pass"))), (F.pmod("supp", F.lit(3)) + 1).cast("int")), "eval_win": m(101), "gammon_threat": m(53), "gammon_risk": m(47)}
    out = p.withColumns(figures)
    return out.withColumn("pip_diff", F.col("pip_p1") - F.col("pip_p2"))


def _theme_rows_sql() -> str:
    def side(x: str, n: str) -> str:
        return f"""{_PIP.format(x)} AS pip_{n}, {x}[1] AS bar_{n}, {x}[26] AS off_{n}, len(list_filter({x}[2:25], lambda v: v = 1)) AS blots_{n}, len(list_filter({x}[2:25], lambda v: v >= 2)) AS made_{n},
{_run(_bits(f"{x}[2:25]", ">= 2"))} AS prime_{n}, len(list_filter({x}[2:7], lambda v: v >= 2)) AS home_{n}, list_sum({x}[20:25]) AS back_{n}"""

    inner = f"""SELECT *, b AS board_p1, c AS board_p2, {side("b", "p1")}, {side("c", "p2")}, {_BACK.format("b")} AS far1, {_BACK.format("c")} AS far2, list_filter(range(1, 25), lambda y: c[26 - y] = 1) AS t,
list_sum(b[8:25]) AS out1, list_sum(c[8:25]) AS out2, len(list_filter(range(1, 25), lambda i: b[i + 1] = 1 AND ((i > 1 AND b[i] < 2) OR (i < 24 AND b[i + 2] < 2)))) AS num_builders_p1,
coalesce(list_max(list_filter(range(19, 25), lambda i: b[i + 1] >= 2)), 0) AS back_anchor_p1, len(list_filter(b[8:19], lambda v: v = 1)) AS outfield_blots_p1, len(list_filter(b[21:25], lambda v: v >= 2)) AS anchors_back_p1,
b[25] >= 2 AND len(list_filter(b[20:24], lambda v: v >= 2)) = 0 AS ace_anchor_only_p1, CASE WHEN part % 2 = 0 THEN 'checker' ELSE 'cube' END AS decision_type, ['No Double', 'Double/Take', 'Double/Pass'][supp % 3 + 1] AS cube_action_optimal,
(part % 101) / 101.0::DOUBLE AS eval_win, (part % 53) / 53.0::DOUBLE AS gammon_threat, (part % 47) / 47.0::DOUBLE AS gammon_risk FROM {POSITIONS}"""
    rows = f"""SELECT *, pip_p1 - pip_p2 AS pip_diff, CASE WHEN out1 = 0 AND b[1] = 0 AND out2 = 0 AND c[1] = 0 THEN 2 WHEN b[1] > 0 OR c[1] > 0 OR far1 + far2 > 24 THEN 0 ELSE 1 END AS match_phase,
CASE WHEN far1 <= 7 THEN 0 ELSE {_run(_bits("b[8:far1 + 1]", "= 0"))} END AS max_gap_p1,
CASE WHEN b[1] > 0 THEN len(list_filter(t, lambda y: y = 25 - dice[1] OR y = 25 - dice[2])) > 0 ELSE len(list_filter(t, lambda y: {_hit_sql()})) > 0 END AS can_hit_p1 FROM ({inner})"""
    flags = {n: "coalesce(" + p.replace("[5]", "[6]") + ", false)" for n, p in themes.STRUCTURAL.items()}
    flags["various_endgames"] += " AND NOT (" + " OR ".join(flags[n] for n in themes.SPECIFIC_ENDGAMES) + ")"
    return "SELECT l_returnflag, l_discount, " + ", ".join(f'{p} AS "theme_{n}"' for n, p in flags.items()) + f" FROM ({rows})"


_THEMES = f"({_theme_rows_sql()})"
_NAMES = list(themes.STRUCTURAL)
_LONG = "(" + " UNION ALL ".join(f"SELECT l_returnflag, l_discount, '{n}' AS theme, \"theme_{n}\" AS f FROM f" for n in _NAMES) + ")"


@query(f"""WITH f AS {_THEMES} SELECT theme, count(*) FILTER (f) AS n, round(avg(f::INT::DOUBLE), 9) AS share FROM {_LONG} GROUP BY 1""")
def theme_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of all structural themes."""
    return themes.frequencies(themes.structural(theme_rows(spark, d)), _NAMES).withColumn("share", F.round("share", 9))


@query(None)
def theme_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return themes.jaccard(themes.structural(theme_rows(spark, d)), list(themes.STRUCTURAL))


@query(None)
def theme_primary(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("game_id").orderBy("move_number", "part", "supp", "l_discount")
    rows = theme_rows(spark, d).withColumn("move_number", F.row_number().over(w))
    full = themes.trajectory(themes.structural(rows))
    order = [*themes.TRAJECTORY, *themes.STRUCTURAL]
    return themes.primary(full, order).groupBy("primary_theme").agg(F.count("*").alias("n"), r6(F.avg("theme_count")).alias("mean_count"), r6(F.avg("l_discount")).alias("avg_error"))


@query(f"""WITH f AS {_THEMES} SELECT l_returnflag, theme, count(*) AS n, round(avg(l_discount), 9) AS avg_error FROM {_LONG} WHERE f GROUP BY 1, 2""")
def player_themes(spark: SparkSession, d: str) -> DataFrame:
    rows = theme_rows(spark, d).withColumn("l_discount", F.col("l_discount").cast("decimal(20,12)"))  # sums in any order are equal
    out = themes.by_player(themes.structural(rows), "l_returnflag", "l_discount", _NAMES)
    return out.withColumn("avg_error", F.round(F.col("avg_error").cast("double"), 9))


_EV = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 1 + l_linenumber % 2 AS roll, 1 + l_partkey % 13 AS a, 1 + l_suppkey % 11 AS b, CAST(2 ** (l_linenumber % 3) AS INT) AS cube, 0.3::DOUBLE + (l_partkey % 50) / 100.0::DOUBLE AS win,
0.1::DOUBLE + (l_suppkey % 10) / 100.0::DOUBLE AS wg, 0.01::DOUBLE AS wbg, 0.1::DOUBLE + (l_partkey % 9) / 100.0::DOUBLE AS lg, 0.01::DOUBLE AS lbg, l_discount AS eq FROM lineitem)"""


def _bary_sql() -> str:
    wins = [("wbg", 3), ("wg - wbg", 2), ("win - wg", 1)]
    losses = [("1 - win - lg", 1), ("lg - lbg", 2), ("lbg", 3)]
    less = "greatest({0} - {1} * cube, 0)"
    out = [(p, less.format("our", k), "opp") for p, k in wins] + [(p, "our", less.format("opp", k)) for p, k in losses]
    met = "(CASE WHEN {0} = 0 THEN 1.0::DOUBLE WHEN {1} = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE + 0.425::DOUBLE * ({1} - {0}) / ({1} + {0}) END)"
    a = " + ".join(f"({p}) * {x}" for p, x, _ in out)
    b = " + ".join(f"({p}) * {y}" for p, _, y in out)
    m = " + ".join(f"({p}) * {met.format(x, y)}" for p, x, y in out)
    return f"SELECT *, {a} AS ba, {b} AS bb, {m} AS m FROM (SELECT *, CASE WHEN roll = 1 THEN a ELSE b END AS our, CASE WHEN roll = 1 THEN b ELSE a END AS opp FROM {_EV})"


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN roll = 1 THEN ba ELSE bb END, 9) AS bary_a, round(CASE WHEN roll = 1 THEN bb ELSE ba END, 9) AS bary_b,
round(CASE WHEN roll = 1 THEN m ELSE 1 - m END, 9) AS mwc, round(sqrt((CASE WHEN roll = 1 THEN ba ELSE bb END - a) ** 2 + (CASE WHEN roll = 1 THEN bb ELSE ba END - b) ** 2), 9) AS magnitude,
round((CASE WHEN roll = 1 THEN eq ELSE -eq END) - (2 * (CASE WHEN roll = 1 THEN m ELSE 1 - m END) - 1), 9) AS gap FROM ({_bary_sql()})""")
def barycentres(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    m = lambda c, k: F.pmod(c, F.lit(k))
    rows = li.withColumns({
        "player_on_roll": 1 + m("l_linenumber", 2), "score_away_p1": 1 + m("l_partkey", 13), "score_away_p2": 1 + m("l_suppkey", 11), "cube_value": F.pow(F.lit(2.0), m("l_linenumber", 3)).cast("int"),
        "eval_win": 0.3 + m("l_partkey", 50) / 100.0, "eval_win_g": 0.1 + m("l_suppkey", 10) / 100.0, "eval_win_bg": F.lit(0.01), "eval_lose_g": 0.1 + m("l_partkey", 9) / 100.0, "eval_lose_bg": F.lit(0.01), "eval_equity": F.col("l_discount"),
    })
    out = barycentric.barycentres(rows, barycentric.linear_table(15))
    r5 = lambda c: F.round(c, 9)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r5("bary_p1_a").alias("bary_a"), r5("bary_p1_b").alias("bary_b"), r5("cubeless_mwc_p1").alias("mwc"), r5("disp_magnitude_p1").alias("magnitude"), r5("cube_gap_p1").alias("gap"))


