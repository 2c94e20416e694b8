import random

from recallgrid.llm import substring
from tests.llm import edge


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))


def test_a_line_said_over_and_over_is_one_passage(spark):
    rng = random.Random(3)
    line = words(rng, 6)
    said = " ".join([line] * 33)
    texts = [f"{words(rng, 80)} {said} {words(rng, 80)}" for _ in range(2)]
    got = substring.substring_report(edge.table(spark, [(i, t, "a") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        at = t.encode().index(said.encode())
        assert r["repeats"] and r["first_doc_ids"] == [0] and r["longest_passage"] > 0.8 * len(said)
        assert all(s["start"] + s["length"] > at and s["start"] < at + len(said) for s in r["spans"])
        assert sum(s["length"] for s in r["dropped_spans"]) == r["dropped_bytes"]
    assert sum(s["length"] for s in got[1]["dropped_spans"]) > 0.8 * len(said)


def test_passages_of_51_words_are_not_lost_at_their_edges(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        passage = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 7))) for _ in range(51))
        rows += [(2 * i + j, f"{words(rng, rng.randint(20, 120))} {passage} {words(rng, rng.randint(20, 120))}", "a") for j in (0, 1)]
    got = substring.substring_report(edge.table(spark, rows + [(1000 + i, words(rng, 200), "a") for i in range(50)]))
    assert sorted(r["doc_id"] for r in got.where("repeats").collect()) == list(range(800))
