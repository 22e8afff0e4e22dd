"""Golden values of boards, hashes, records, scores, themes and barycentres."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import board, core, hashing, score
from millrace.operators import barycentric, themes
from millrace.sources import records, transcripts

SIGNED = [0] * 24
for at, n in {23: 2, 12: 5, 7: 3, 5: 5, 0: -2, 11: -5, 16: -3, 18: -5}.items():
    SIGNED[at] = n
START = [0] * 26
for at, n in {24: 2, 13: 5, 8: 3, 6: 5}.items():
    START[at] = n


def slots(**points):
    b = [0] * 26
    for k, n in points.items():
        b[int(k[1:])] = n
    return b


def one(spark, columns, **values):
    from pyspark.sql import types as T

    kinds = {list: T.ArrayType(T.IntegerType()), int: T.IntegerType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}
    schema = T.StructType([T.StructField(k, kinds[type(v)]) for k, v in values.items()])
    df = spark.createDataFrame([tuple(values.values())], schema)
    return df.select(*(c.alias(n) for n, c in columns.items())).first().asDict(recursive=True)


def test_starting_position(spark):
    zero = F.lit(0)
    got = one(spark, {"f": board.derived_features(F.col("s"), zero, zero), "px": board.signed_pips(F.col("s"), zero, 1), "po": board.signed_pips(F.col("s"), zero, -1), "ok": board.is_valid(F.col("s"), zero, zero, zero, zero)}, s=SIGNED)
    assert (got["px"], got["po"], got["ok"]) == (167, 167, True)
    assert got["f"]["blot_x"] == 0 and got["f"]["made_x"] == 4 and got["f"]["pos_class"] == board.CONTACT and got["f"]["pip_diff"] == 0
    b = F.col("b")
    got = one(spark, {"pip": board.pip_count(b), "gap": board.max_gap(b), "back": board.back_checker(b), "phase": board.phase(b, b)}, b=START)
    assert got == {"pip": 167, "gap": 10, "back": 24, "phase": board.CONTACT}


@pytest.mark.parametrize(
    ("points", "want"),
    [
        ({"p4": 2, "p5": 2, "p6": 2, "p8": 2}, (3, 4)),
        ({"p1": 2}, (1, 0)),
        ({}, (0, 0)),
        ({"p1": 2, "p2": 3, "p20": 2, "p21": 2}, (2, 1)),
    ],
)
def test_primes(spark, points, want):
    b = F.col("b")
    got = one(spark, {"n": board.longest_prime(b), "at": board.prime_location(b)}, b=slots(**points))
    assert (got["n"], got["at"]) == want


@pytest.mark.parametrize(
    ("own", "other", "dice", "want"),
    [
        (slots(p10=1), slots(p19=1), [4, 1], True),  # the blot stands on 6 from our side
        (slots(p10=1), slots(p19=1), [3, 1], True),  # 3 + 1 over free points
        (slots(p10=1), slots(p19=1, p18=2, p16=2), [3, 1], False),  # both ways are held
        (slots(p10=1), slots(p19=1), [2, 2], True),
        (slots(p10=1), slots(p19=1), [1, 1], True),
        (slots(p10=1), slots(p19=1, p17=2), [2, 2], False),
        (slots(p0=1, p10=1), slots(p19=1), [4, 1], False),  # the bar comes first
        (slots(p0=1), slots(p3=1), [3, 1], True),
        (slots(p10=1), slots(p19=2), [4, 1], False),
    ],
)
def test_hits(spark, own, other, dice, want):
    assert one(spark, {"h": board.can_hit(F.col("a"), F.col("b"), F.col("d"))}, a=own, b=other, d=dice)["h"] is want


def test_phases(spark):
    c = {"p": board.phase(F.col("a"), F.col("b"))}
    assert one(spark, c, a=slots(p1=15), b=slots(p6=15))["p"] == board.BEAROFF
    assert one(spark, c, a=slots(p10=15), b=slots(p12=15))["p"] == board.RACE
    assert one(spark, c, a=slots(p13=15), b=slots(p12=15))["p"] == board.CONTACT
    assert one(spark, c, a=slots(p0=1, p1=14), b=slots(p1=15))["p"] == board.CONTACT


def test_record_round_trip_and_hash(spark):
    boards = np.array([SIGNED, [0] * 24])
    small = {k: np.array([0, 0]) for k in records.SMALL} | {"bar_x": np.array([0, 15]), "off_o": np.array([0, 15])}
    data = records.encode(boards, small, np.array([-5, 7]))
    assert len(data) == 160
    r, blocks = records.scan(data)
    assert not blocks and (records.boards(r) == boards).all() and records.valid(r).tolist() == [True, True]
    assert r["pip_x"].tolist() == [167, 375] and r["hash"].view(np.int64).tolist() == [-5, 7]
    block = bytes([records.ENGINE, 1]) + (3).to_bytes(2, "little") + b"abc"
    with_block = bytearray(data[:80])
    with_block[65] = 1
    r, blocks = records.scan(bytes(with_block) + block + data[80:])
    assert len(r) == 2 and blocks == [(0, records.ENGINE, 1, b"abc")]
    with pytest.raises(ValueError):
        records.scan(data[:100])
    files = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    got = records.decoded(files).collect()
    assert [x["board"] for x in got] == boards.tolist() and got[0]["valid"]


def test_zobrist_depends_on_context_only_in_the_full_hash(spark):
    z = F.lit(0)
    h = board_only = hashing.board_hash(F.col("s"), z, z, z, z)
    got = one(spark, {"a": h, "b": hashing.context_hash(board_only, F.lit(0), z, z, F.lit(3), F.lit(3)), "c": hashing.context_hash(board_only, F.lit(1), z, z, F.lit(3), F.lit(3))}, s=SIGNED)
    assert len({got["a"], got["b"], got["c"]}) == 3
    k, want = hashing.zobrist_keys(), 0
    for i, n in enumerate(SIGNED):
        for level in range(4):
            want ^= k["x"][level][i] if n > level else k["o"][level][i] if -n > level else 0
        want ^= k["count"][i][abs(n)]
    for name in ("bar_x", "bar_o", "off_x", "off_o"):
        want ^= k[name][0]
    assert got["a"] == want


def test_packed_hash(spark):
    import xxhash

    z = F.lit(0).cast("long")
    got = one(spark, {"h": hashing.packed_hash(F.col("b"), z + 1, z, z + 3, z + 70000)}, b=START)["h"]
    raw = bytes(START) + bytes([1, 0]) + (3).to_bytes(2, "little") + (65535).to_bytes(2, "little")
    assert got % 2**64 == xxhash.xxh64_intdigest(raw)


def test_scores(spark):
    a, b = F.col("a"), F.col("b")
    c = {"tp": score.take_point(a, b), "v": score.variant(a, b, F.lit(False)), "lead": score.leader(a, b)}
    assert one(spark, c, a=0, b=5)["tp"] == 0.25
    got = one(spark, c, a=1, b=3)
    assert got["v"] == "post_crawford" and got["lead"] == 1 and 0 <= got["tp"] <= 0.5
    flags = {"m": score.missed_double(F.col("p"), F.col("o")), "t": score.wrong_take(F.col("p"), F.col("o")), "w": score.wrong_pass(F.col("p"), F.col("o"))}
    assert one(spark, flags, p="No Double", o="Double/Take") == {"m": True, "t": False, "w": False}
    assert one(spark, flags, p="Double/Take", o="Double/Pass") == {"m": False, "t": True, "w": False}
    assert one(spark, flags, p="Double/Pass", o="Double/Take") == {"m": False, "t": False, "w": True}


def test_buckets(spark):
    c = {"x": core.bucket(F.col("v"), [1, 5], ["low", "middle", "high"])}
    assert [one(spark, c, v=v)["x"] for v in (1, 2, 5, 6)] == ["low", "middle", "middle", "high"]
    w = {"x": core.width_bin(F.col("v"), 0.0, 2.0, 4)}
    assert [one(spark, w, v=v)["x"] for v in (-0.1, 0.0, 0.49, 0.5, 1.99, 2.0)] == [0, 1, 1, 2, 4, 5]


# --- themes

NEUTRAL = dict(
    match_phase=0, move_number=10, decision_type="checker", cube_action_optimal="", eval_win=0.5, gammon_threat=0.1, gammon_risk=0.1, pip_p1=100, pip_p2=100, bar_p1=0, bar_p2=0, off_p1=1, off_p2=1,
    blots_p1=0, blots_p2=0, made_p1=4, made_p2=4, prime_p1=1, prime_p2=1, home_p1=1, home_p2=1, back_p1=3, back_p2=3, num_builders_p1=0, back_anchor_p1=0, anchors_back_p1=0, ace_anchor_only_p1=False,
    outfield_blots_p1=1, max_gap_p1=5, can_hit_p1=False, pip_diff=0, board_p1=[0] * 26, board_p2=[0] * 26,
)
FIVE = slots(p5=2)
POSITIVE = {
    "opening": dict(move_number=3, off_p1=0, off_p2=0, pip_p1=160, pip_p2=160), "flexibility": dict(move_number=8, num_builders_p1=3, blots_p1=2), "middle_game": dict(off_p1=0, off_p2=0), "5_point": dict(board_p1=FIVE, back_p1=2, back_p2=2),
    "blitz": dict(home_p1=3, bar_p2=1, back_p1=2), "one_man_back": dict(back_p1=1, prime_p2=4), "holding": dict(back_anchor_p1=20, pip_diff=10, anchors_back_p1=1), "priming": dict(prime_p1=4), "connectivity": dict(max_gap_p1=2, outfield_blots_p1=0),
    "hit_or_not": dict(blots_p2=1, can_hit_p1=True), "crunch": dict(blots_p1=3, back_anchor_p1=21), "action_doubles": dict(decision_type="cube", cube_action_optimal="Double/Take", eval_win=0.6, gammon_threat=0.2), "late_blitz": dict(move_number=20, home_p1=4, bar_p2=1),
    "too_good": dict(decision_type="cube", cube_action_optimal="No Double", eval_win=0.8, gammon_threat=0.5), "ace_point": dict(ace_anchor_only_p1=True), "back_game": dict(anchors_back_p1=2, pip_diff=20), "containment": dict(pip_diff=-10, prime_p1=4, home_p1=5),
    "playing_gammon": dict(home_p1=5, gammon_threat=0.3, eval_win=0.7), "saving_gammon": dict(eval_win=0.1, gammon_risk=0.3, off_p1=0, back_p1=0), "bearoff_vs_contact": dict(pip_p1=60), "various_endgames": dict(pip_p1=70, pip_p2=70, back_p2=1), "race": dict(match_phase=1), "bearoff": dict(match_phase=2),
}


def test_every_theme_has_a_case():
    assert set(POSITIVE) == set(themes.STRUCTURAL)


def test_themes(spark):
    rows = [NEUTRAL | {"case": "none"}] + [NEUTRAL | over | {"case": name} for name, over in POSITIVE.items()]
    rows.append(NEUTRAL | {"case": "nulls", "eval_win": None, "pip_p1": None, "match_phase": None})
    rows.append(NEUTRAL | {"case": "specific", "pip_p1": 60, "pip_p2": 70})
    ints = [k for k, v in NEUTRAL.items() if isinstance(v, int) and not isinstance(v, bool)]
    schema = ", ".join(f"{k} {'array<int>' if k.startswith('board') else 'int' if k in ints else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in (NEUTRAL | {"case": ""}).items())
    got = {r["case"]: r for r in themes.structural(spark.createDataFrame([tuple(r[k] for k in (*NEUTRAL, "case")) for r in rows], schema)).collect()}
    assert not any(got["none"][f"theme_{n}"] for n in themes.STRUCTURAL)
    assert not any(got["nulls"][f"theme_{n}"] for n in themes.STRUCTURAL)
    for name in POSITIVE:
        assert got[name][f"theme_{name}"], name
    assert got["specific"]["theme_bearoff_vs_contact"] and not got["specific"]["theme_various_endgames"]


def test_trajectory_themes_need_a_full_window(spark):
    rows = [(1, m, 3 if m < 9 else 1, 1, m == 1, False, 0, 3, 0, 0.5, 100) for m in range(1, 11)]
    df = spark.createDataFrame(rows, "game_id int, move_number int, back_p1 int, anchors_back_p1 int, theme_blitz boolean, theme_ace_point boolean, match_phase int, back_p2 int, bar_p2 int, eval_win double, pip_p1 int")
    got = {r["move_number"]: r for r in themes.trajectory(df).collect()}
    assert [m for m in got if got[m]["theme_breaking_anchor"]] == [9]
    assert [m for m in got if got[m]["theme_post_blitz_turnaround"]] == [8]


# --- barycentres


def bary(spark, compat=False, **over):
    row = dict(player_on_roll=1, score_away_p1=7, score_away_p2=7, cube_value=1, eval_win=0.5, eval_win_g=0.2, eval_win_bg=0.02, eval_lose_g=0.18, eval_lose_bg=0.01, eval_equity=0.0) | over
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if k.startswith('eval') else 'int'}" for k in row))
    return barycentric.barycentres(df, barycentric.linear_table(15), compat).first().asDict()


def test_barycentre_invariants(spark):
    a, b = bary(spark), bary(spark, player_on_roll=2)
    assert a["bary_p1_a"] == pytest.approx(b["bary_p1_b"]) and a["cubeless_mwc_p1"] == pytest.approx(1 - b["cubeless_mwc_p1"])
    assert bary(spark, cube_value=0) == {**a, "cube_value": 0}
    last = bary(spark, score_away_p1=1, score_away_p2=1)
    assert last["cubeless_mwc_p1"] == pytest.approx(0.5) and 0 <= last["bary_p1_a"] <= 1
    assert bary(spark, score_away_p1=1, score_away_p2=1, eval_win=0.7)["cubeless_mwc_p1"] == pytest.approx(0.7)
    assert bary(spark, compat=True, score_away_p1=1, score_away_p2=1, eval_win=0.7)["cubeless_mwc_p1"] == pytest.approx(0.3)
    assert bary(spark, eval_equity=0.4, player_on_roll=2)["cubeful_equity_p1"] == -0.4


# --- transcripts

MATCH = """; [Event "Club"]

7 point match

 Game 1
 Ann Lee : 0                     Bo : 2
  1) 51: 13/8 24/23              61: 13/7 8/7
  2) 43: 24/20 23/20              Doubles => 2
  3)  Takes                      11: 24/23
  4) 62:                         53: 8/3
      Wins 2 points
"""


def test_transcript():
    got = transcripts.parse(MATCH)
    assert got[0] == (7, 1, "Ann Lee", "Bo", 0, 2, 1, 1, "checker", [5, 1], "13/8 24/23")
    assert [(r[7], r[8]) for r in got[:6]] == [(1, "checker"), (2, "checker"), (1, "checker"), (2, "double"), (1, "take"), (2, "checker")]
    assert got[6][9:] == ([6, 2], "")
    assert got[-1][8] == "win"
    assert transcripts.parse("") == []


def test_transcript_files(spark):
    files = spark.createDataFrame([("m", bytearray(MATCH.encode())), ("empty", bytearray())], "path string, content binary")
    assert transcripts.parsed(files).count() == len(transcripts.parse(MATCH))
