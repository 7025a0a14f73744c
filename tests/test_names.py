"""Names of a table against registered ones, by grams, equal comparing all with all."""

import random
import re

from cuepoint.operators import registry

ALPHABET = "abé中 ."


def stem(name):
    return re.sub(r"\.[^.]*$", "", name)


def brute(known, wanted):
    out = {}
    for w in {w for w in wanted if w is not None}:
        near = [(order, name) for order, name in known if name is not None and (name == w or stem(w) in stem(name) or stem(name) in stem(w))]
        if near:
            out[w] = min(near)
    return out


def found(spark, known, wanted):
    rows = spark.createDataFrame(known, "at int, title string")
    asked = spark.createDataFrame([(w,) for w in wanted], "wanted string")
    got = registry.match_name_table(rows, asked, "title", "at").collect()
    assert len({r.wanted for r in got}) == len(got)
    return {r.wanted: (r["at"], r.title) for r in got}


def test_equals_all_pairs(spark):
    for seed, length in ((1, 4), (2, 9)):
        rng = random.Random(seed)
        made = lambda: "".join(rng.choices(ALPHABET, k=rng.randint(1, length)))  # noqa: B023, E731
        some = [(i, made() if i % 11 else None) for i in range(60)]
        known = [(i, n) for i, n in some if n is None or stem(n)]
        wanted = [made() for _ in range(80)] + [None, "", ".mp4", "zzzz", *(n for _, n in known[:5]), *(n + "more" for _, n in known[:9] if n)]
        assert found(spark, known, wanted) == brute(known, wanted)


def test_empty_names_and_tables(spark):
    known = [(3, "lecture.mp4"), (2, ".hidden"), (5, ""), (1, None)]
    wanted = ["lecture", "other", "", None]
    assert found(spark, known, wanted) == brute(known, wanted)
    assert found(spark, [], wanted) == {} and found(spark, known, []) == {}


def test_a_frequent_gram_isnt_multiplied_out(spark):
    known = spark.range(20_000).selectExpr("cast(id AS int) AS at", "concat('lecture ', lpad(id, 6, '0'), '.mp4') AS title")
    wanted = spark.range(2000).selectExpr("concat('lecture ', lpad(id * 10, 6, '0'), ' cut.mkv') AS wanted")
    got = registry.match_name_table(known, wanted, "title", "at").collect()
    assert len(got) == 2000 and all(int(r.wanted[8:14]) == r["at"] for r in got)
