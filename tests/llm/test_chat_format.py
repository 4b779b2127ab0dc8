import random

import pytest
from pyspark.sql import functions as F

from veilframe.llm import chat_format as C

HOSTILE = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST]", "<s", "[INST", "<s><s>[[INST]]", "é😀 <s>", "", " lead and trail ", "<s>[INST] user [/INST] x</s>"]


def rows_of(n_conv=20, seed=1):
    rnd = random.Random(seed)
    for c in range(n_conv):
        for t in range(rnd.randint(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            yield c, t, role, rnd.choice(HOSTILE) + "word " * rnd.choice([0, 3, 40, 200, 900])


def test_escape_is_one_to_one_and_hides_control_strings(spark):
    df = spark.createDataFrame([(x,) for x in HOSTILE], "t string").select("t", C.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", C.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(k in r.e for k in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_windows_against_a_plain_reading(spark):
    rows = list(rows_of())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.windows(df).select("*", C.read_back(F.col("formatted")).alias("turns")).collect()
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        mine = sorted((w for w in out if w.conv_id == c), key=lambda w: w.window)
        own = [tuple(t) for w in mine for t in w.turns[w.n_repeated :]]
        assert own == turns
        loss = [w.formatted[s.start : s.end] for w in mine for s in w.loss]
        assert len(loss) == sum(r == "assistant" for r, _ in turns)
        sizes = [C.TURN_TOKENS + -(-len(t) // C.TOKEN_CHARS) for _, t in turns]
        done = 0
        for k, w in enumerate(mine):
            repeated = [tuple(t) for t in w.turns[: w.n_repeated]]
            system = turns[0][0] == "system"
            assert (k == 0) <= (not repeated)
            if k and system:
                assert repeated[0] == turns[0]
                repeated = repeated[1:]
            assert repeated == turns[done - len(repeated) : done]
            assert sum(sizes[done - len(repeated) : done]) <= C.HISTORY and len(repeated) <= C.HISTORY_TURNS
            n = len(w.turns) - w.n_repeated
            whole = sum(C.TURN_TOKENS + -(-len(t) // C.TOKEN_CHARS) for _, t in w.turns)
            assert whole <= C.BUDGET or n == 1 and not repeated
            done += n


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, 0, None, None, 9), (1, 0, "user", "b", 9), (1, 0, "user", "b", 9), (1, None, "user", "first", 9), (None, 1, "assistant", "x", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    got = {r.conv_id: r for r in C.windows(df).select("conv_id", "n_repeated", C.read_back(F.col("formatted")).alias("t"), "loss").collect()}
    assert [tuple(t) for t in got[1].t] == [("user", "first"), ("", ""), ("user", "b"), ("user", "b")]
    assert len(got[None].loss) == 1
    assert C.digests(C.windows(df.limit(0))).collect() == []


@pytest.mark.parametrize("roles", [["assistant"], ["system"], ["tool", "assistant", "assistant"]])
def test_odd_roles(spark, roles):
    df = spark.createDataFrame([(5, i, r, f"text {i}") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    (r,) = C.digests(C.windows(df)).collect()
    assert r.n_turns == len(roles) and r.loss_chars == 6 * roles.count("assistant")


def test_windows_are_filled_within_the_budget_system_turn_included(spark):
    rnd = random.Random(8)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], "x" * rnd.randint(0, 900 if t else 2000)) for c in range(30) for t in range(40)]
    out = C.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("*", C.read_back(F.col("formatted")).alias("turns")).collect()
    size = lambda turns: sum(C.TURN_TOKENS + -(-len(t.text) // C.TOKEN_CHARS) for t in turns)
    last = {c: max(w.window for w in out if w.conv_id == c) for c in range(30)}
    assert all(size(w.turns) <= C.BUDGET for w in out)
    own = [size(w.turns[w.n_repeated :]) for w in out if w.window < last[w.conv_id] and w.conv_id % 2 == 0]
    assert sum(own) / len(own) > 0.6 * (C.BUDGET - C.HISTORY)
