import pytest

from evidentia.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string, pair_id long, chosen string"


def run(spark, chosen, rejected):
    row = spark.createDataFrame([(1, chosen, rejected, "x", 3)], f"pair_id long, chosen {C.TURNS}, rejected {C.TURNS}, prompt string, n_common int")
    return C.format_preferences(row).first()


def line(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def trained(text, mask):
    return [text[int(a) : int(b)] for a, b in (m.split(":") for m in mask.split(",") if m)]


U, A, B = ("user", "hi"), ("assistant", "héllo"), ("assistant", "go away")


@pytest.mark.parametrize(
    "chosen,rejected,n",
    [([U, A], [U, B], 1), ([U, A, U, A], [U, A, U, B], 3), ([U, A], [U, A], 2), ([A], [B], 0), ([U, A, U], [U], 1), ([], [U, A], 0), (None, [U, A], 0), (None, None, 0), ([("user", "x" * 300_000), A], [("user", "x" * 300_000), B], 1)],
)
def test_prefix_completions_and_masks(spark, chosen, rejected, n):
    r = run(spark, chosen, rejected)
    c, j = chosen or [], rejected or []
    assert (r["n_common"], r["prompt"]) == (n, "".join(line(*t) for t in c[:n]))
    for turns, text, mask in ((c, r["chosen"], r["chosen_mask"]), (j, r["rejected"], r["rejected_mask"])):
        assert text == "".join(line(*t) for t in turns[n:])
        assert trained(text, mask) == [f"{t}<|end|>" for role, t in turns[n:] if role == "assistant"]


def test_pairs_of_a_table(spark):
    rows = [(0, 0, "user", "q", 1, "x"), (0, 1, "assistant", "a0", 1, "x"), (0, 2, "user", "bye", 1, "x"), (1, 1, "assistant", "a1", 1, "x"), (1, 0, "user", None, 1, "x"), (1, 0, "user", None, 1, "x"), (2, 0, "assistant", "alone", 1, "x"), (4, 0, "user", "no reply", 1, "x"), (5, 0, "assistant", "x", 1, "x"), (None, 0, "assistant", "x", 1, "x"), (8, None, None, "t", None, None)]
    got = {r["pair_id"]: r for r in C.format_preferences(C.paired_replies(spark.createDataFrame(rows, TURNS))).collect()}
    assert set(got) == {0, 1, 2, 5}  # each conversation with a reply; the last one is followed by the first
    assert (got[0]["prompt"], got[0]["chosen"], got[0]["rejected"]) == (line("user", "q"), line("assistant", "a0"), line("assistant", "a1"))
    assert got[1]["prompt"] == line("user", "") and got[1]["rejected"] == line("assistant", "alone")
    assert got[5]["rejected"] == line("assistant", "a0")
    assert C.paired_replies(spark.createDataFrame([], TURNS)).count() == 0


def test_pairs_part_at_any_depth(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"c{i}t{t}", 1, "x") for i in range(40) for t in range(2 + 2 * (i % 4) + i % 2)]
    got = C.format_preferences(C.paired_replies(spark.createDataFrame(rows, TURNS).repartition(5))).collect()
    assert len(got) == 40 and {r["n_common"] for r in got} == {1, 3, 5, 7}
    for r in got:
        i = r["pair_id"]
        m, j = 1 + i % 4, (i + 1) % 40
        assert r["n_common"] == 2 * (i % m) + 1 and r["rejected"] == line("assistant", f"c{j}t{2 * (j % 4) + 1}")
        assert r["prompt"] + r["chosen"] == "".join(line("user" if t % 2 == 0 else "assistant", f"c{i}t{t}") for t in range(2 * m))
