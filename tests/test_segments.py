"""Claims and what their segments must and must not be."""

import pytest

from plumbline.functions.segments import segmented, segments_of

CASES = {
    "Vaccines do not cause autism or the flu.": ["Vaccines do not cause autism", "Vaccines do not cause the flu"],
    "They kill bacteria, not the viruses behind colds.": ["They kill bacteria", "They do not kill the viruses behind colds"],
    "Garlic lowers cholesterol; zinc shortens colds and helps the throat": ["Garlic lowers cholesterol", "zinc shortens colds and helps the throat"],
    "Diets rich in fruit, vegetables and fibre reduce the risk of cancer": ["Diets rich in fruit reduce the risk of cancer", "Diets rich in vegetables reduce the risk of cancer", "Diets rich in fibre reduce the risk of cancer"],
    "Yoghurt supports a healthy and balanced gut": ["Yoghurt supports a healthy and balanced gut"],
    "Laughter releases endorphins that can decrease pain and has been shown to help the heart": ["Laughter releases endorphins that can decrease pain", "Laughter has been shown to help the heart"],
    "Some people bake it into a cake or other food.": ["Some people bake it into a cake or other food"],
    "Vitamin D for bone growth in children and DHA for eye and brain development": None,
    "Adults have longer nights. Sugar causes more harm than salt does.": ["Adults have longer nights", "Sugar causes", "more harm than salt does"],
    "Short.": ["Short"],
    "": [],
}


@pytest.mark.parametrize("claim", CASES)
def test_segments(claim):
    got = segments_of(claim)
    if CASES[claim] is not None:
        assert got == CASES[claim]
    else:
        low = [s.lower() for s in got]
        assert any("vitamin d" in s and "bone growth" in s for s in low) and any("dha" in s for s in low) and "brain development" not in low


def test_brackets_stay_whole():
    got = segments_of("Low-fat diets with fruit (foods that are low in fat and may hold fibre and vitamin C) may reduce the risk of some cancers.")
    assert all(("(" in s) == (")" in s) for s in got) and not any(s.startswith("may hold") for s in got)


def test_no_segment_begins_with_a_joint():
    for claim in ("Coffee helps alertness and tea helps sleep", "Zinc helps but sugar hurts", "A healthy diet rich in vegetables and fruit may help reduce the risk of some cancers."):
        assert segments_of(claim) and not any(s.lower().startswith(("and ", "or ", "but ")) for s in segments_of(claim))


def test_table(spark):
    rows = segmented(spark.createDataFrame([(1, "Vaccines do not cause autism or the flu."), (2, None), (None, "One claim here is enough")], "claim_id long, claim string")).collect()
    assert sorted(((r["claim_id"] or 0), r["part"], r["segment"]) for r in rows) == [(0, 1, "One claim here is enough"), (1, 1, "Vaccines do not cause autism"), (1, 2, "Vaccines do not cause the flu")]


@pytest.mark.parametrize(
    ("claim", "want"),
    [
        ("Colds are caused by viruses, not bacteria", ["Colds are caused by viruses", "Colds are not caused by bacteria"]),
        ("It cures colds, not the flu", ["It cures colds", "It does not cure the flu"]),
        ("Zinc, iron and copper help growth in children", ["Zinc help growth in children", "iron help growth in children", "copper help growth in children"]),
        ("In children, zinc and iron help growth", ["In children, zinc and iron help growth"]),
        ("Vitamin C is an acid that helps the skin heal", ["Vitamin C is an acid", "Vitamin C helps the skin heal"]),
        ("Take: 1. zinc daily for colds 2. iron weekly for anemia", ["zinc daily for colds", "iron weekly for anemia"]),
        ("Coffee helps alertness. Coffee helps alertness!", ["Coffee helps alertness"]),
        ("Zinc may prevent and treat colds, according to medical research.", ["Zinc may prevent and treat colds"]),
        ("Tea reduces the risk of cancer and stroke", ["Tea reduces the risk of cancer", "Tea reduces the risk of stroke"]),
    ],
)
def test_more_segments(claim, want):
    assert segments_of(claim) == want


@pytest.mark.parametrize("name", ["benchmark", "documents", "conversations"])
def test_segments_of_whole_tables(spark, name):
    """Whatever the text: segments have only its words, begin with no joint, come once, and no text loses all of itself."""
    rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").selectExpr("row_number() OVER (ORDER BY text) AS claim_id", "text AS claim").filter("claim IS NOT NULL")
    found = {}
    for r in segmented(rows).collect():
        found.setdefault(r.claim_id, []).append((r.part, r.segment))
    bare = lambda x: {w.strip("()[]{},.;:!?\"").lower() for w in x.split()}
    for r in rows.collect():
        mine = [s for _, s in sorted(found.get(r.claim_id, []))]
        assert bool(mine) == bool(r.claim.strip(" \n\t,.;:!?")), r.claim
        assert len({s.lower() for s in mine}) == len(mine)
        known = bare(r.claim)
        for s in mine:
            assert s.split()[0].lower() not in ("and", "or", "but")
            words = bare(s) - known
            assert all(w in ("do", "does", "not") or any(w in k or k.startswith(w[:3]) for k in known) for w in words), (s, words)
