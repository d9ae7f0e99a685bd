"""Links over the corpus, written to the store, and names."""

import numpy as np
import pytest

from lodestrata.operators import identity as I
from lodestrata.operators import store as S

CLUSTERS = "id long, meeting_id long, label long, v array<double>, seconds double, speaker_id long"


def unit(*x):
    return [float(y) for y in np.array(x) / np.linalg.norm(x)]


@pytest.fixture(scope="module")
def groups(spark):
    a, b, c, d = unit(1, 0, 0, 0), unit(0, 1, 0, 0), unit(0, 0, 1, 0), unit(0, 0, 0, 1)
    rows = [
        (1, 1, 0, a, 600.0, 7), (2, 2, 0, a, 400.0, None),  # named in one meeting; linked in the other
        (3, 1, 1, b, 100.0, None), (4, 2, 1, b, 90.0, None), (5, 3, 1, b, 80.0, None),  # nobody knows
        (6, 3, 2, c, 100.0, None), (7, 4, 2, c, 100.0, None),  # claimed through the bank
        (8, 5, 3, d, 70.0, None), (9, 5, 3, d, 70.0, None),  # one voice twice in a meeting: two groups
        (10, 6, 0, a, 59.0, None),  # too short
    ]
    bank = spark.createDataFrame([(2, c)], "person long, v array<double>")
    return rows, I.link_groups(spark.createDataFrame(rows, CLUSTERS), bank)


def test_link_groups(groups):
    got = {r.id: (r.grp, r.speaker_id, r.how) for r in groups[1].collect()}
    assert got == {
        1: (1, 7, "named"), 2: (1, 7, "inherited"), 3: (3, None, "linked"), 4: (3, None, "linked"), 5: (3, None, "linked"),
        6: (6, 2, "claimed"), 7: (6, 2, "claimed"), 8: (8, None, "linked"), 9: (9, None, "linked"),
    }
    assert I.link_conflicts(groups[1]).isEmpty()


def test_no_chain_below_the_average(spark):
    """0 is near 1 and 1 near 2, but 0 and 2 aren't: the average of the three stays under the bar."""
    v = [unit(1, 0, 0), unit(1, 0.9, 0), unit(0, 1, 0)]
    rows = [(i, i, 0, x, 100.0, None) for i, x in enumerate(v)]
    p = I.replace(I.DEFAULTS, link_accept=0.85)
    got = {r.id: r.link for r in I.linked(spark.createDataFrame(rows, CLUSTERS), p).collect()}
    assert got[0] != got[2] and len(set(got.values())) == 2


def test_apply_and_name(groups, spark):
    rows, linked = groups
    clusters = spark.createDataFrame([(r[0], r[1], f"G{r[0]}", r[4], 10 if r[0] in (1, 10) else 11 if r[0] == 3 else None) for r in rows], "id long, meeting_id long, cluster string, seconds double, group_id long")
    store = S.Store(
        spark.createDataFrame([(7, "Alice Berg"), (2, "Bob")], "id long, name string"),
        spark.createDataFrame([(10, 7), (11, None)], "group_id long, speaker_id long"),
        clusters,
        spark.createDataFrame([(7, "room", [1.0, 0.0], 5.0)], "speaker_id long, condition string, v array<double>, seconds double"),
    )
    done = I.link_apply(store, linked)
    at = {r.id: r.group_id for r in done.clusters.collect()}
    who = {r.group_id: r.speaker_id for r in done.groups.collect()}
    assert at[1] == at[2] == at[10] == 10 and who[10] == 7  # the person's group is used again; a short cluster keeps it
    assert at[3] == at[4] == at[5] > 11 and who[at[3]] is None and who[at[6]] == 2 and 11 not in who
    assert all(r.n == 0 for r in S.integrity(done).collect())
