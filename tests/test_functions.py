import pytest
from pyspark.sql import functions as F

from kinlink.functions import fuzzy, indic, phonetic, text


def one(spark, column, *values):
    names = "abcdef"[: len(values)]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([values], schema).select(column(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Bright Cafe LLC", "bright cafe"),
        ("Krishna Sweets Pvt Ltd", "krishna sweets"),
        ("Café de la Paix SARL", "cafe de la paix"),
        ("Cœur", "coeur"),
        ("Straße", "strasse"),
        ("Æon Œuvre", "aeon oeuvre"),
        ("Łódź", "lodz"),
        ("A & B, Inc.", "a and b"),
        ("A and B", "a b"),
        ("राम मार्केटिंग", "ram marketing"),
        ("Acme (Holdings) Grp 24x7", "acme group"),
        ("Customer#000000001", "customer"),
        (None, ""),
        ("", ""),
    ],
)
def test_normalize_name(spark, raw, clean):
    assert one(spark, text.normalize_name, raw) == clean


def test_latin_folding_in_the_jvm_agrees(spark):
    names = [("Łódź & Söhne GmbH",), ("Crème Brûlée SAS",), ("plain ltd",), ("Ünïcode é́",)]
    df = spark.createDataFrame(names, "n string")
    rows = df.select(text.normalize_name(F.col("n")).alias("a"), text.normalize_name(F.col("n"), text.fold_latin).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_addresses_countries_and_scripts(spark):
    assert one(spark, text.normalize_address, "500 Market Street, San Jose") == "500 market st san jose"
    assert one(spark, text.normalize_country, "  India ") == "india"
    flags = [one(spark, text.is_non_latin, x) for x in ("abc é", "राम", "abc я", "123", None)]
    assert flags == [0, 1, 1, 0, 0]


def test_all_nine_scripts_become_latin():
    words = ("राम", "বাংলা", "ਪੰਜਾਬ", "ગુજરાત", "ଓଡ଼ିଶା", "தமிழ்", "తెలుగు", "ಕನ್ನಡ", "മലയാളം")
    assert all(indic.transliterate(w).isascii() and indic.transliterate(w) for w in words)
    assert indic.transliterate("plain é") == "plain é"


def test_normalization_adds_only_what_is_there(spark):
    df = spark.createDataFrame([("राम Ltd", "x")], "business_name string, other string")
    out = text.apply_normalization(df)
    assert out.columns == ["business_name", "other", "business_name_clean", "business_name_is_non_latin"]
    assert tuple(out.first())[2:] == ("ram", 1)


def test_keys(spark):
    assert one(spark, text.initialism, "International Business Machines") == "IBM"
    assert one(spark, text.initialism, "ibm") == "IBM"
    assert one(spark, text.initialism, "12") == ""
    assert one(spark, text.token_sort, "b  A c") == "a b c"
    assert one(spark, text.is_company_name, "acme inc") == 1 and one(spark, text.is_company_name, "incline") == 0
    assert one(spark, text.name_core_key, "acme enterprises", "12 main st dover") == "acme|st dover"
    assert one(spark, text.name_core_key, "ab", "x") is None
    assert one(spark, text.pin_keys, "x 560001 y 1234567 94103") == ["560001", "94103"]
    assert one(spark, text.trigrams, "a bcd") == ["abc", "bcd"] and one(spark, text.trigrams, "a b") == ["ab"]


def test_phonetic(spark):
    assert [one(spark, phonetic.soundex, x) for x in ("Robert", "Ashcraft", "Tymczak", "1a", "")] == ["R163", "A261", "T522", "", ""]
    assert len({phonetic.metaphone_text(x) for x in ("smith", "smyth", "smithe")}) == 1
    assert phonetic.metaphone_text("knight school") == "NT SKL"
    assert phonetic.nysiis_text("") == "" and phonetic.nysiis_text("macdonald") == "MCDANALD"
    vote = one(spark, lambda a, b, c, d: phonetic.vote([(a, b), (c, d)]), "X", "X", "", "Y")
    assert vote == 1.0


def test_fuzzy_scores():
    assert fuzzy.weighted_ratio("acme", "acme") == fuzzy.ratio("", "") == fuzzy.partial_ratio("abc", "xabcx") == 1.0
    assert fuzzy.weighted_ratio("acme robotics", "acme robotics inc") > 0.85
    assert fuzzy.token_sort_ratio("acme robotics", "acme robotics inc") > 0.8
    assert fuzzy.weighted_ratio("acme robotics", "bright cafe") < 0.6
    assert fuzzy.weighted_ratio("", "a") == 0.0
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert fuzzy.token_set_ratio("a b c", "b a") == 1.0


def test_lcs_against_dynamic_programming():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert fuzzy.lcs_length(a, b) == row[-1]


def test_ratios_of_many_pairs_equal_those_of_one():
    import random

    rng = random.Random(5)
    words = "alpha beta gamma services private pvt ltd rose café नमस्ते 12 main street co. x 漢字".split()
    phrase = lambda: " ".join(rng.choice(words) if rng.random() < 0.8 else "".join(rng.choice("abcdeho ") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, rng.choice((3, 6, 18)))))
    a = [phrase() for _ in range(600)] + ["", "", "x" * 80, "y" * 63]
    b = [phrase() if rng.random() < 0.5 else "".join(c for c in a[k] if rng.random() < 0.9) for k in range(600)] + ["", "a", "x" * 70 + "y", "y" * 64]
    for name in ("ratio", "partial_ratio", "token_sort_ratio", "weighted_ratio", "jaro_winkler"):
        many = getattr(fuzzy, f"{name}_many")(a, b)
        assert many == pytest.approx([getattr(fuzzy, name)(x, y) for x, y in zip(a, b, strict=True)], abs=1e-12), name
    sort, partial = fuzzy.token_sort_ratio_many(a, b), fuzzy.partial_ratio_many(a, b)
    assert (fuzzy.weighted_ratio_many(a, b, sort, partial) == fuzzy.weighted_ratio_many(a, b)).all()


def test_more_letters_than_a_chunk_takes(monkeypatch):
    monkeypatch.setattr(fuzzy, "LETTERS", 8)
    a = ["".join(map(chr, range(97 + 3 * k, 103 + 3 * k))) for k in range(6)]
    b = [x[::2] + "zz" for x in a]
    assert fuzzy.ratio_many(a, b) == pytest.approx([fuzzy.ratio(x, y) for x, y in zip(a, b, strict=True)])
