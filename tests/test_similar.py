"""Strains that share families by chance are no candidates."""

import random
from itertools import combinations

import pytest
from helixlake.operators import mixture as M


@pytest.mark.parametrize("least", [0.0, 0.08, 0.3, 0.95])
def test_candidates(spark, least):
    """Few pairs are counted where strains are unlike, and no like pair is lost."""
    rng = random.Random(3)
    sets = {s: set(rng.sample(range(1000), rng.choice([1, 2, 40, 100]))) for s in range(60)}
    sets |= {100 + s: (sets[s] - set(rng.sample(range(1000), 20 * s))) or {5} for s in range(20)}  # like some of them by more or less
    presence = spark.createDataFrame([(f, s) for s, fams in sets.items() for f in fams], "fam long, strain long")
    jaccard = {(s, t): len(sets[s] & sets[t]) / len(sets[s] | sets[t]) for s, t in combinations(sorted(sets), 2) if sets[s] & sets[t]}
    got = {(r["s"], r["t"]): r["jaccard"] for r in M.similar_strains(presence, least).collect()}
    assert got == {p: j for p, j in jaccard.items() if j >= least}
    candidates = M.candidate_strains(presence, least).count()
    if least == 0.08:
        assert len(got) <= candidates < 0.5 * len(jaccard)
