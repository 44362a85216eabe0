"""Context devices and their lines come as they are read: no file and no exchange holds them."""
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from dialoom.operators import generate as G, sampling as S

KEYS = ["row_id", "persona", "copy"]


def _entries(spark, sf_dir):
    from dialoom.plans.generate import piles
    p = piles(spark, sf_dir)
    examples = G.status_examples(p["status"].limit(200).withColumns({"persona": F.lit("assistant"), "copy": F.lit(1)}), p, 42, KEYS)
    return G.finish_examples(G.stage(examples), p, 42, KEYS)


def test_lines_are_neither_staged_nor_moved(spark, sf_dir, monkeypatch):
    staged, stage = [], S.stage
    monkeypatch.setattr(S, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    entries = _entries(spark, sf_dir)
    assert staged and not any({"rank", "device_name"} <= set(df.columns) for df in staged)
    plan = entries._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [re.search(r"[A-Za-z]", x).start() if re.search(r"[A-Za-z]", x) else 0 for x in plan]
    made = [i for i, x in enumerate(plan) if "Generate posexplode" in x]
    assert len(made) == 2  # of media players, and of all others
    for i in made:
        above, at = [], depth[i]
        for k in range(i, -1, -1):
            if depth[k] < at:
                above, at = [*above, plan[k]], depth[k]
        assert above and not any("Exchange" in x for x in above)
    assert entries.count() == 200


def test_no_walk_is_longer_than_its_refusals_ask_for(spark):
    """Examples that must refuse nearly all of a pile still get all they want, in the order of their walk."""
    kinds = ["light"] * 97 + ["lock", "fan", "todo"]
    devices = spark.createDataFrame([("en", f"{k}.small_ring_{i}", "x") for i, k in enumerate(kinds)] + [("pl", f"todo.p{i}", "y") for i in range(7)],
                                    "language string, device_name string, description string")
    examples = spark.createDataFrame([(i, "pl" if i % 4 == 0 else "en", ["light.small_ring_x"] if i % 2 else []) for i in range(40)], "k int, language string, avoid array<string>")
    rows = S.sample_context_devices(examples, devices, 7, ["k"], 30, carry=["language"]).collect()
    of = {k: sorted(((r["rank"], r["device_name"]) for r in rows if r["k"] == k)) for k in range(40)}
    assert all([r for r, _ in v] == list(range(len(v))) and len({d for _, d in v}) == len(v) for v in of.values())
    assert all({d.split(".")[0] for _, d in of[k]} <= {"lock", "fan", "todo"} and 2 <= len(of[k]) <= 3 for k in range(1, 40, 2))
    assert {r["language"] for r in rows if r["k"] % 4 == 0} == {"pl"} and all(d.startswith("todo.p") and len(of[k]) <= 7 for k in range(0, 40, 4) for _, d in of[k])


def test_likeness_is_that_of_difflib():
    rand = random.Random(5)
    word = lambda letters, most: "".join(rand.choice(letters) for _ in range(rand.randint(0, most)))
    pairs = [(word(a, 18), word(a, 18)) for a in ("ab", "abc_", "small_ringbolt0123456789") for _ in range(1500)] + [(word("abcd ", 260), word("abcd ", 260)) for _ in range(60)]
    for a, b in pairs:
        ratio = SequenceMatcher(None, a, b).ratio()
        for limit in (0.4, ratio, rand.random()):
            assert S.likeness(limit)(a, b) == (ratio >= limit)


def test_examples_are_dealt_once_before_they_grow(spark, sf_dir):
    """No entry is moved or staged: what the five kinds come from is dealt by the entries' keys, and that is all that moves."""
    from dialoom.plans.generate import g6_build_sft
    plan = g6_build_sft(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    # the join of examples with their lines, the sort of each side, and the union of the five kinds right below it
    at = next(i for i, x in enumerate(plan) if "SortMergeJoin [row_id#" in x)
    below = [re.sub(r"^[ :+*\-0-9()]*", "", x).split(" ")[0] for x in plan[at + 1:at + 6]]
    assert "Union" in below and "Exchange" not in below[:below.index("Union")]
    dealt = [x for x in plan if "REPARTITION_BY_NUM" in x and "row_id#" in x]
    assert len(dealt) >= 6 and not any("Exchange hashpartitioning(row_id#" in x and "ENSURE_REQUIREMENTS" in x for x in plan)
