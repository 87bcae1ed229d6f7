"""Parser and readings: representative names with the parts they stand for."""

import pytest
from pyspark.sql import functions as F

from lumenframe.functions.names import FIELDS, alternative_readings, merge_parsed, parse, parse_name, readings

NAMES = [
    ("Amarcord [Federico Fellini, 1973]", dict(title="Amarcord", year=1973, director="Federico Fellini")),
    ("Chinatown (Polanski, USA, 1974)", dict(title="Chinatown", year=1974, director="Polanski", countries=["USA"])),
    ("Annie Hall [1977, USA]", dict(title="Annie Hall", year=1977, countries=["USA"])),
    ("1900 (Novecento) (1976) [mkvonly]", dict(title="1900 (Novecento)", year=1976)),
    ("Arabian.Nights.1974.CC.1080p.BluRay.FLAC1.0.x264-ADE", dict(title="Arabian Nights", year=1974, resolution="1080p", source="BluRay", codec="H.264", release_group="ADE")),
    ("Auf.der.anderen.Seite.German.AC3.DVDRiP.XviD-EMPiRE", dict(title="Auf der anderen Seite", source="DVDRip", codec="XviD", language="de", release_group="EMPiRE")),
    ("El viaje de Chihiro DVDRIP SPANISH DIVX (www.lamejorfrikiweb.cjb.net)", dict(title="El viaje de Chihiro", source="DVDRip", codec="DivX", language="es")),
    ("Antes de la Lluvia-Before the Rain (Milko Manchevski -1994- Uk-Fr-Macedonia)", dict(title="Antes de la Lluvia-Before the Rain", year=1994, director="Milko Manchevski", countries=["Uk-Fr-Macedonia"])),
    ("Benning, James - The United States of America (2022)", dict(title="The United States of America", year=2022, director="James Benning")),
    ("1976 - 9 Lives of a Wet Pussy", dict(title="9 Lives of a Wet Pussy", year=1976)),
    ("BuSan_Tsai Ming-lian", dict(title="BuSan", director="Tsai Ming-lian")),
    ("1990", dict(title="1990")),
    ("Eight and a Half (1963) 720p.BRRip.x264.AC3-WAF", dict(title="Eight and a Half", year=1963, resolution="720p", source="BluRay", codec="H.264")),
    ("The.Movie.tt0111161.720p", dict(title="The Movie", resolution="720p", imdb_id="tt0111161")),
    ("2001.A.Space.Odyssey.1968.1080p.BluRay", dict(title="2001 A Space Odyssey", year=1968, resolution="1080p", source="BluRay")),
    ("01 - LA CIÉNAGA (Lucrecia Martel, 2001)", dict(title="LA CIÉNAGA", year=2001, director="Lucrecia Martel")),
    ("[1975] Welfare (1975, 168')", dict(title="Welfare", year=1975, countries=["168'"])),
    ("[1973] Juan Moreira [rodriguezalvarez.com]", dict(title="Juan Moreira", year=1973)),
    ("EL_DEPENDIENTE [multiplexado]", dict(title="EL DEPENDIENTE [multiplexado]")),
    ("(1990) 1080p", dict(title="1990) 1080p", year=1990, resolution="1080p")),
    ("Some Film_Jane Doe x", dict(title="Some Film", director="Jane Doe x")),
    ("Some Film_[tag] x", dict(title="Some Film [tag] x")),
    ("A_B C_D", dict(title="A_B C_D")),
    ("Foo.Bar.H.264.AAC-GRP", dict(title="Foo Bar", codec="H.264", release_group="GRP")),
    ("", {}),
    ("300 - Rise of an Empire (2014)", dict(title="300 - Rise of an Empire", year=2014)),
]

READINGS = [
    (("Azor - Andreas Fontana", ""), [("Azor", "Andreas Fontana"), ("Andreas Fontana", "Azor")]),
    (("C.Chabrol-Madame Bovary", ""), [("C.Chabrol", "Madame Bovary"), ("Madame Bovary", "C.Chabrol")]),
    (("Melancholia, Lars Von Trier", ""), [("Melancholia", "Lars Von Trier")]),
    (("300 - Rise of an Empire", ""), []),
    (("Mediterraneo G Salvatore", ""), [("Mediterraneo G", "Salvatore"), ("Mediterraneo", "G Salvatore")]),
    (("Loulou Pialat", ""), [("Loulou", "Pialat")]),
    (("Jean-Luc Godard-A bout de souffle", ""), [("Jean", "Luc Godard-A bout de souffle"), ("Luc Godard-A bout de souffle", "Jean"), ("Jean-Luc Godard", "A bout de souffle"), ("A bout de souffle", "Jean-Luc Godard")]),
    (("A - B C - D E", ""), [("A", "B C - D E"), ("B C - D E", "A")]),
    (("Melancholia, Lars Von Trier", "Trier"), [("Melancholia", "Lars Von Trier"), ("Trier", "Melancholia, Lars Von Trier")]),
    (("Azor - Azor", ""), [("Azor", "Azor")]),
    (("Foo", "foo"), []),
    (("Spider-Man", ""), []),
    (("La notte", ""), []),
    (("mediterraneo g salvatore", ""), [("mediterraneo g", "salvatore"), ("mediterraneo", "g salvatore")]),
    (("L'ivresse du pouvoir,C Chabrol", ""), [("L'ivresse du pouvoir", "C Chabrol")]),
    (("300 - Rise of an Empire Smith", ""), []),
    (("Amélie", "Amelie"), []),
    (("Amarcord", ""), []),
    (("", ""), []),
    (("Azor - ÁZOR", ""), [("Azor", "ÁZOR")]),
]


@pytest.mark.parametrize("name,want", NAMES)
def test_parse(name, want):
    blank = dict.fromkeys(FIELDS, "") | {"year": 0, "countries": []}
    assert parse(name) == blank | want


@pytest.mark.parametrize("pair,want", READINGS)
def test_readings(pair, want):
    assert readings(*pair) == want


def test_columns(spark):
    df = spark.createDataFrame([("Chinatown (Polanski, USA, 1974)", "Chinatown.1974.1080p.BluRay.x264-X")], "a string, b string")
    got = df.select(parse_name("a").alias("a"), parse_name("b").alias("b")).select(merge_parsed("a", "b").alias("m"), alternative_readings(F.lit("Loulou Pialat"), F.lit("")).alias("r")).first()
    assert (got.m.director, got.m.year, got.m.resolution, got.m.countries) == ("Polanski", 1974, "1080p", ["USA"])
    assert [tuple(x) for x in got.r] == [("Loulou", "Pialat")]
