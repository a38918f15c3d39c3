"""Preference pairs against plain Python."""

from affectlake.llm.conversations import neighbours, preference_pairs

SCHEMA = "conv_id long, turn long, role string, text string, pair_id string"


def formatted(spark, rows):
    got = preference_pairs(neighbours(spark.createDataFrame(rows, SCHEMA)))
    return {r.pair_id: r.asDict() for r in got.collect()}


def test_shared_turns_are_rendered_once(spark):
    rows = [
        (0, 0, "user", "hi", ""), (0, 1, "assistant", "good", ""), (0, 2, "user", "ok", ""),
        (1, 0, "user", "hi", ""), (1, 1, "assistant", "bad 日本", ""), (1, 1, "assistant", "bad 日本", ""),
    ]
    one = formatted(spark, rows)[0]
    assert (one["chosen_id"], one["rejected_id"], one["n_shared"]) == (0, 1, 1)
    assert one["prompt"] == "<|user|>\nhi<|end|>\n"
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n<|user|>\nok<|end|>\n"
    for side, said in (("chosen", ["good"]), ("rejected", ["bad 日本"])):
        spans = [tuple(map(int, s.split(":"))) for s in one[f"{side}_mask"].split(";")]
        assert [one[side][a:b] for a, b in spans] == said


def test_equal_missing_and_null(spark):
    rows = [
        (2, 0, "user", "x", ""), (3, 0, "user", "x", ""), (4, 0, None, None, ""), (None, 0, "user", "lost", ""),
        (7, 1, "assistant", "b", ""), (7, 1, "assistant", "a", ""),
    ]
    got = formatted(spark, rows)
    assert got.keys() == {1, 2, 3}
    assert (got[1]["n_shared"], got[1]["chosen"], got[1]["rejected"]) == (1, "", "")
    assert (got[2]["rejected_id"], got[2]["n_shared"], got[2]["chosen"]) == (None, 0, "<||>\n<|end|>\n")
    assert got[3]["rejected"].index("\na<") < got[3]["rejected"].index("\nb<")


def test_empty_and_long(spark):
    assert formatted(spark, []) == {}
    long = "x" * 300_000
    got = formatted(spark, [(0, i, "assistant", long, "") for i in range(3)] + [(1, 0, "assistant", long, "")])
    assert got[0]["n_shared"] == 1 and len(got[0]["chosen"]) > 600_000
