"""Walks for context devices go no further than they have to, and only media players draw a title."""
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from dialoom import fixed
from dialoom.operators import generate as G, sampling as S


def _devices(spark, n):
    kinds = F.array(*map(F.lit, fixed.DEVICE_DOMAINS))
    kind = F.element_at(kinds, (F.col("id") % len(fixed.DEVICE_DOMAINS) + 1).cast("int"))
    return spark.range(n).select(F.concat(kind, F.lit(".small_ring_"), "id").alias("device_name"), F.lit("x").alias("description"), F.lit("en").alias("language"))


def _examples(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.lit("en").alias("language"), F.array(F.lit("light.small_ring_7")).alias("avoid"))


def test_first_walks_cover_the_need_and_little_more(spark, monkeypatch):
    staged, stage = [], S.stage
    monkeypatch.setattr(S, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    rows = S.sample_context_devices(_examples(spark, 400), _devices(spark, 2000), 3, ["k"]).collect()
    start = next(df for df in staged if "_length" in df.columns)
    length, want = start.agg(F.sum("_length"), F.sum("_want")).first()
    assert want < length < 1.3 * want + 13 * 400 and len(rows) == want


def test_small_and_large_piles_give_the_same_devices(spark, monkeypatch):
    """Sent around or dealt out, in one walk or several."""
    def got():
        return sorted(map(tuple, S.sample_context_devices(_examples(spark, 60), _devices(spark, 600), 5, ["k"], 40, carry=["language"]).collect()))
    one = got()
    monkeypatch.setattr(S, "POOL_SENT", 0)
    monkeypatch.setattr(S, "STEPS_A_TASK", 100)
    assert got() == one and len({r[0] for r in one}) == 60
    assert all(x[2].split(".")[0] != "light" or SequenceMatcher(None, "light.small_ring_7", x[2].split(".")[1]).ratio() < 0.4 for x in one)


def test_only_media_players_draw_a_title(spark, sf_dir, monkeypatch):
    from dialoom.plans.generate import piles
    drawn, draw = [], S.draw_from_pile
    p = piles(spark, sf_dir)
    examples = G.status_examples(p["status"].limit(30).withColumns({"persona": F.lit("assistant"), "copy": F.lit(1)}), p, 42, ["row_id", "persona", "copy"])

    def noted(df, *args):
        if "rank" in df.columns:
            drawn.append({r["type"] for r in df.select("type").distinct().collect()})
        return draw(df, *args)

    monkeypatch.setattr(S, "draw_from_pile", noted)
    lines = G.finish_examples(G.stage(examples), p, 42, ["row_id", "persona", "copy"]).select(F.explode("states").alias("s")).where("s like 'media_player.%'")
    assert drawn == [{"media_player"}] and lines.where("s rlike 'playing;[a-z]+ [a-z]+;vol='").count() > 0
