from pyspark.sql import functions as F

from phyllon.llm.chat_format import conversations_of, paired_with_neighbour, preference_pairs

TURNS = "array<struct<role: string, text: string>>"


def test_common_prefix(spark):
    u, a = ("user", "hi"), ("assistant", "yo")
    rows = [
        (1, [u, a, u, ("assistant", "good é")], [u, a, u, ("assistant", "bad")]),
        (2, [u, a], [u, a]),
        (3, [u], [("user", "other"), a]),
        (4, [], [u]),
        (5, None, None),
        (6, [u, (None, None), a], [u, (None, None)]),
        (7, [u, ("user", None)], [u, ("user", "")]),
    ]
    df = spark.createDataFrame(rows, f"id long, chosen {TURNS}, rejected {TURNS}").withColumn("prompt", F.lit("old"))
    got = {r["id"]: r for r in preference_pairs(df).collect()}
    assert [got[i]["n_prompt"] for i in range(1, 8)] == [3, 2, 0, 0, 0, 2, 1]
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi\n<|assistant|>\nyo\n<|user|>\nhi\n"
    assert (one["chosen_completion"], one["rejected_completion"]) == ("<|assistant|>\ngood é\n", "<|assistant|>\nbad\n")
    start, end = one["chosen_mask"][0]
    assert one["chosen_completion"][start:end] == "good é\n"
    assert got[2]["chosen_completion"] == "" and got[2]["chosen_mask"] == []
    assert got[3]["prompt"] == "" and [tuple(m) for m in got[3]["rejected_mask"]] == [(29, 32)]
    assert got[6]["prompt"] == "<|user|>\nhi\n<||>\n\n"


def test_turns_are_ordered_and_paired(spark):
    rows = [(2, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "q"), (3, 1, "assistant", "r"), (4, 0, "user", "alone"), (5, 0, "assistant", "s"), (None, 0, "user", "x"), (2, None, "user", "late")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conv = conversations_of(turns)
    assert [t["text"] for t in conv.filter("conv_id = 2").first()["turns"]] == ["a", "b", "late"]
    got = {r["conv_id"]: r["rejected"] and [t["text"] for t in r["rejected"]] for r in paired_with_neighbour(conv).collect()}
    assert got == {2: ["a", "r", "late"], 3: ["q", "b"], 4: None, 5: None}  # none is lost for its partner
    alone = {r["conv_id"]: r for r in preference_pairs(paired_with_neighbour(conv)).collect()}[5]
    assert (alone["n_prompt"], alone["chosen_completion"], alone["rejected_completion"], alone["rejected_mask"]) == (0, "<|assistant|>\ns\n", "", [])
    assert preference_pairs(paired_with_neighbour(conversations_of(turns.limit(0)))).collect() == []


def test_long_turns_and_repeated_rows(spark):
    long = "word " * 1_200_000
    rows = [(0, 0, "user", long), (0, 1, "assistant", long), (1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 1, "assistant", "r")]
    got = {r["conv_id"]: r for r in preference_pairs(paired_with_neighbour(conversations_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert got[0]["n_prompt"] == 1 and [tuple(m) for m in got[0]["chosen_mask"]] == [(14, 14 + len(long) + 1)]
    assert got[1]["chosen_completion"].endswith("r\n") and len(got[1]["chosen_mask"]) == 1 and got[1]["n_prompt"] == 2  # the repeated turn is a turn
