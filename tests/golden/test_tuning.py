import math

from shoebox.operators import tuning


def test_own_distance_is_found_behind_any_number_of_others(spark):
    turn = lambda a: [math.cos(a), math.sin(a)]
    # twenty faces of others lie between the two of person 1; person 3 has one face
    rows = [(1, 1, turn(0)), (2, 1, turn(1)), *((10 + i, 2, turn(0.01 * i + 0.4)) for i in range(20)), (40, 3, turn(2)), (50, None, turn(0.1))]
    got = {r.id: r for r in tuning.person_distances(spark.createDataFrame(rows, "id bigint, person_id bigint, vec array<double>")).collect()}
    assert len(got) == 23
    assert round(got[1].pos, 6) == round(got[2].pos, 6) == round(1 - math.cos(1), 6)
    # the largest of the nearest (0.4), the second nearest (0.41) and the mean direction of all twenty
    angles = [0.01 * i + 0.4 for i in range(20)]
    centre = [sum(f(a) for a in angles) for f in (math.cos, math.sin)]
    assert abs(got[1].neg - max(1 - math.cos(0.41), 1 - centre[0] / math.hypot(*centre))) < 1e-9
    # the nearest of person 1 is at 1, but its two faces' direction is 0.5
    assert got[40].pos is None and abs(got[40].neg - (1 - math.cos(1.5))) < 1e-9
