"""Vectors within a radius, against all pairs."""

import random

import pytest

from paperloom.operators import similarity


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("most, bands", [(3, 2), (10, None), (10, 4), (16, 4), (16, 9), (0, None)])
def test_every_number_of_bands_finds_all_pairs(spark, most, bands):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(40)]
    flip = lambda x: x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(most + 4)))
    left = [(i, b) for i, b in enumerate(base)]
    right = [(i, flip(rng.choice(base))) for i in range(60)] + [(100, base[0])]
    mk = lambda rows: spark.createDataFrame([(i, signed(b)) for i, b in rows] + [(7, None), (None, 5), (rows[0][0], signed(rows[0][1]))], "id long, bits long")
    for a, b in ((left, right), (right, left)):
        want = {(i, j, (x ^ y).bit_count()) for i, x in a for j, y in b if (x ^ y).bit_count() <= most}
        got = [(r.id, r.other_id, r.distance) for r in similarity.near_bits(mk(a), mk(b), most, bands=bands).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_radii_leave_no_room_between_bands():
    for most in range(20):
        for bands in range(1, most + 2):
            assert sum(r + 1 for r in similarity.band_radii(most, bands)) == most + 1


def test_fewer_pairs_meet_as_tables_grow():
    met = [similarity.bands_for(n, n, 10, 64)[2] for n in (10**3, 10**5, 10**7)]
    assert met == sorted(met, reverse=True) and met[1] < 0.01 and met[2] < 0.002
    assert similarity.bands_for(10**7, 10**7, 16, 64)[2] < 0.1


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, bits long")
    some = spark.createDataFrame([(1, 5)], "id long, bits long")
    assert similarity.near_bits(none, some).collect() == similarity.near_bits(some, none).collect() == []
