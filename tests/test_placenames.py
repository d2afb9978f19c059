"""Places by similar text against brute force over all pairs of names."""

import random

from litgraph.operators import placenames as pn

SCHEMA = "city string, country string, latitude double, longitude double"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(city, country):
    def one(x):
        return " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    return f"{one(city)}, {one(country)}" if city and country and one(city) and one(country) else None


def test_similar_places_equal_brute_force(spark):
    rnd = random.Random(2)
    entries = [("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))), rnd.choice(["ab", "cad", "bada"]),
                float(i), float(-i)) for i in range(150)] + [("São Paulo", "Brazil", 1.0, 2.0), ("Sao Paulo", "Brazil", 3.0, 4.0)]
    places = []
    for city, country, _, _ in entries:
        for _ in range(4):
            t = list(city)
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randint(0, len(t))
                t[at:at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "x", "-"])
            places.append(("".join(t), country))
    places += [("SAO  PAULO", "brazil"), ("SãoPaulo", "Brazil."), (None, "ab"), ("ab", None), ("", ""), ("!", "ab"), ("zzzzzzzz", "zzzz")]
    gaz = spark.createDataFrame(entries, SCHEMA)
    got = {(r.city, r.country): (r.distance, r.matched_city, r.matched_country, r.latitude, r.longitude)
           for r in pn.similar_places(spark.createDataFrame(places, "city string, country string"), gaz).collect()}
    want = {}
    for city, country in set(places):
        name = plain(city, country)
        if name is None:
            continue
        near = []
        for c, k, lat, lon in entries:
            other = plain(c, k)
            d = distance(name, other)
            if d <= min(2, min(len(name), len(other)) // 4):
                near.append((d, other, c, k, lat, lon))
        if near:
            d, _, c, k, lat, lon = min(near)
            want[city, country] = (d, c, k, lat, lon)
    assert got == want and len(want) > 200
    assert {d for d, *_ in got.values()} == {0, 1, 2}


def test_exact_entries_come_first_and_unknown_places_stay_null(spark):
    gaz = spark.createDataFrame([("Bonn", "Germany", 1.0, 1.0), ("bonn", "Germany", 2.0, 2.0), (None, "Peru", 3.0, 3.0)], SCHEMA)
    df = spark.createDataFrame([(1, "bonn", "Germany"), (2, "Bonn", "Germany"), (3, "BONN", "GERMANY"), (4, "Bon", "Germani"),
                                (5, None, "Peru"), (6, "Rome", "Italy"), (7, None, None), (8, "Bonn", "Germany")],
                               "id int, city string, country string")
    got = {r.id: (r.latitude, r.place_distance) for r in pn.geocode_similar(df, gaz).collect()}
    assert got == {1: (2.0, 0), 2: (1.0, 0), 3: (1.0, 0), 4: (1.0, 2), 5: (3.0, 0), 6: (None, None), 7: (None, None), 8: (1.0, 0)}
    assert pn.geocode_similar(df, gaz.where("false")).where("latitude is not null").isEmpty()
