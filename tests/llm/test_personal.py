import pytest

from loomline.llm import personal as P

FINDER = P.Finder({"grace": (True, False), "holloway": (False, True), "felix": (True, False), "tanaka": (False, True), "shanly": (False, True), "frank": (True, False)})


def kinds(text):
    return [(k, text[a:b]) for a, b, k in FINDER.find(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to a.b+c@mail.example.org today", [("email", "a.b+c@mail.example.org")]),
        ("x14 (at) post (dot) example (dot) org", [("email", "x14 (at) post (dot) example (dot) org")]),
        ("mail JANE AT SITE DOT TEST, please", [("email", "JANE AT SITE DOT TEST")]),
        ("we looked at the map and at the dot on it", []),
        ("stock @ 48.84 and @some_one", []),
        ("call +1 203 555 0171 now", [("phone", "+1 203 555 0171")]),
        ("fax (714) 555-0153.", [("phone", "(714) 555-0153")]),
        ("(+33 1 99 00 22 22)", [("phone", "+33 1 99 00 22 22")]),
        ("555-0194 ext. 37", [("phone", "555-0194 ext. 37")]),
        ("ring five five five, 0 1 1 0 tonight", [("phone", "five five five, 0 1 1 0")]),
        ("one of the pilots and two of the others", []),
        ("SSN 964-24-0545", [("id_number", "964-24-0545")]),
        ("Steuer-ID 04635240139,", [("id_number", "04635240139")]),
        ("NI no QQ 74 19 64 A and", [("id_number", "QQ 74 19 64 A")]),
        ("my passport expired in 2002", []),
        ("Case 65 443 860 148, serial 355-813194-37, 192.0.2.144, patent 5,512,611, box 4511 3652", []),
        ("at 425 Maple Hollow Place", [("address", "425 Maple Hollow Place")]),
        ("Flat 5, 23 Juniper Lane, Oakhaven.", [("address", "Flat 5, 23 Juniper Lane, Oakhaven")]),
        ("P.O. Box 88, Dunwell on", [("address", "P.O. Box 88, Dunwell")]),
        ("in 29 bis, rue des Tilleuls, had", [("address", "29 bis, rue des Tilleuls")]),
        ("Calle Las Norias 83, Grayford.", [("address", "Calle Las Norias 83, Grayford")]),
        ("an Ahornstraße 67.", [("address", "Ahornstraße 67")]),
        ("a user called zoba ignored 980 emails", []),
        ("Highway 58 and County Road 564, 50 Court hearings and 1438 Road workers", []),
        ("Grace Holloway, felix tanaka, G. Holloway and Holloway, Grace", [("name", "Grace Holloway"), ("name", "felix tanaka"), ("name", "G. Holloway"), ("name", "Holloway, Grace")]),
        ("FELIX J. O'SHANLY", [("name", "FELIX J. O'SHANLY")]),
        ("Holloway Avenue, Felix from there, the Frank River, Holloway & Tanaka", []),
        ("", []),
    ],
)
def test_items(text, want):
    assert kinds(text) == want


def test_items_inside_items_do_not_count():
    assert [k for k, _ in kinds("grace.holloway@mail.example and 12 Grace Holloway Street")] == ["email", "address"]


def test_corpus_teaches_names(spark):
    rows = []
    for i in range(40):
        rows += [f"My neighbor Grace Holloway saw it {i}.", "Ask Felix Tanaka about the box.", "The Baba Holdings report was edited.", "Baba Holdings and Baba Holdings."]
    rows += ["so grace tanaka was there", "by Baba Holdings", None, ""]
    rows += ["plain words about nothing at all in the archive again"] * 900
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "delivery_no long, text string, kind string").repartition(3)
    got = {r["key"]: r["clean"] for r in P.sanitised(df, "delivery_no").collect()}
    assert got[0] == "My neighbor [NAME] saw it 0." and got[1] == "Ask [NAME] about the box."
    assert got[160] == "so [NAME] was there" and got[161] == "by Baba Holdings"
    assert got[162] is None and got[163] == ""
    by_join = {r["key"]: r["clean"] for r in P.sanitised(df, "delivery_no", at_hand=1).collect()}
    assert by_join == got
    items = P.items(df, "delivery_no")
    assert items.where("key = 0").collect()[0][1:] == ("name", 1)
    assert items.columns == ["key", "kind", "nth"]


def test_numbered_per_kind_and_row(spark):
    t = "a@b.example, c@d.example; +1 203 555 0171"
    df = spark.createDataFrame([(7, t), (7, t)], "k long, text string")
    got = sorted(map(tuple, P.items(df, "k").collect()))
    assert got == sorted([(7, "email", 1), (7, "email", 2), (7, "phone", 1)] * 2)


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "k long, text string")
    assert P.items(df, "k").count() == 0 and P.sanitised(df, "k").count() == 0
    long_ = "word " * 60_000 + "a@b.example " + "1 " * 5000
    assert [k for k, _ in kinds(long_)].count("email") == 1


def test_letters_that_grow_when_lowered_keep_places():
    text = "İİİ a@b.example"
    assert kinds(text) == [("email", "a@b.example")]


# Written after the forms. 21 of 26 were found at first; numbers of letters and digits mixed and Italian words of other use were mended then.
HELD_OUT = [
    ("id_number", "My NI is AB 12 34 56 C, keep it", "AB 12 34 56 C"),
    ("id_number", "national insurance number: JG103759A", "JG103759A"),
    ("id_number", "passport C01X00T47 was stolen", "C01X00T47"),
    ("id_number", "Passport No. 533401372", "533401372"),
    ("id_number", "Reisepass C4VM8KL21 verloren", "C4VM8KL21"),
    ("id_number", "DNI 12345678Z", "12345678Z"),
    ("id_number", "NIE: X1234567L", "X1234567L"),
    ("id_number", "codice fiscale RSSMRA85T10A562S", "RSSMRA85T10A562S"),
    ("id_number", "numéro de sécurité sociale 2 84 05 75 123 456 78", "2 84 05 75 123 456 78"),
    ("id_number", "Personalausweis L01X00T471", "L01X00T471"),
    ("id_number", "her SSN is 219-09-9999", "219-09-9999"),
    ("id_number", "ITIN 912-91-3457", "912-91-3457"),
    ("id_number", "driving licence MORGA753116SM9IJ", "MORGA753116SM9IJ"),
    ("address", "he lives at Via Roma 12, Milano", "Via Roma 12, Milano"),
    ("address", "spedire a Viale Monza 140, 20127 Milano", "Viale Monza 140, 20127 Milano"),
    ("address", "Piazza del Duomo 3, Firenze", "Piazza del Duomo 3, Firenze"),
    ("address", "Calle de Alcalá 45, 28014 Madrid", "Calle de Alcalá 45, 28014 Madrid"),
    ("address", "Paseo de la Castellana 200, Madrid", "Paseo de la Castellana 200, Madrid"),
    ("address", "Avenida de América 9, Sevilla", "Avenida de América 9, Sevilla"),
    ("address", "14 Rue de Rivoli 75001 Paris", "14 Rue de Rivoli 75001 Paris"),
    ("address", "8 avenue Foch, 75116 Paris", "8 avenue Foch, 75116 Paris"),
    ("address", "27 boulevard Voltaire, Lyon", "27 boulevard Voltaire, Lyon"),
    ("address", "Hauptstraße 5, 10115 Berlin", "Hauptstraße 5, 10115 Berlin"),
    ("address", "Lindenweg 12b, 80331 München", "Lindenweg 12b, 80331 München"),
    ("address", "221 Baker Street, London", "221 Baker Street, London"),
    ("address", "Apt 4, 1600 Sunset Blvd, Springfield, IL 62704", "Apt 4, 1600 Sunset Blvd, Springfield, IL 62704"),
]
NO_ITEMS = [
    "sent via email 12 times",
    "we walked along the corso for 3 hours",
    "flight AB 1234 was late",
    "model X1234567 was recalled",
    "the largo takes 12 minutes",
    "case C01X00T47 is closed",
    "via page 12 of the report",
    "1970 Quail Project denied it",
    "route 66 and 20 minutes drive",
]


def test_held_out_formats():
    missed = [(t, kinds(t)) for k, t, want in HELD_OUT if (k, want) not in kinds(t)]
    assert len(missed) <= 0.1 * len(HELD_OUT), missed
    assert [t for t in NO_ITEMS if kinds(t)] == []


def test_the_corpus_teaches_introductions(spark):
    names = [(g, f) for g in ("Grace", "Felix", "Nora", "Ivan", "Petra") for f in ("Holloway", "Tanaka", "Marsh", "Okoye", "Lind")]
    rows = [f"My friend {g} {f} saw it." for g, f in names for _ in range(2)]
    rows += [f"It was filed under {g} {f} that year." for g, f in names] + ["It was filed under Zelda Quorn twice.", "It was filed under Zelda Quorn again.", "zelda quorn came too"]
    rows += ["The Baba Holdings report.", "The Hoka Trust board."] * 200 + ["plain words about nothing at all in the archive again"] * 900
    df = spark.createDataFrame(list(enumerate(rows)), "k long, text string").repartition(3)
    got = {r["key"]: r["clean"] for r in P.sanitised(df, "k").collect()}
    assert got[77] == "[NAME] came too" and got[78] == "The Baba Holdings report."
