"""PII surrogates (op 6): detection, format, coreference, distinctness; held against plain Python."""

import re
import string

from flowlens.llm import op6_pii, registry
from tests.llm.cases import SF, edge_docs, empty_docs, sf_rows

MIXED = [
    (1, "Mail anna.b-7@Mail3.Example.com or ANNA.B-7@MAIL3.EXAMPLE.COM now, host 10.20.30.40."),
    (2, "anna.b-7@mail3.example.com again; call +1 (017) 555-7713 or +1 017 555 7713, card 4111 1111 1111 1111."),
    (3, "card 4111111111111111 and 4111-1111-1111-1112; ssn 123-45-6789; IBAN DE89 3704 0044 0532 0130 00."),
    (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF" password: hunter2hunter2'),
    (5, "Frau Meier met Herr Meier and Mrs Anna Smith. Г-жа? госпожа Иванова и господин Иванов."),
    (6, "No person here, 3.14 and 2024-01-02, section 1.2.3, price 1,000,000 and 12345."),
    (7, None), (8, ""), (None, "null id 10.20.30.40"), (9, "иван.петров@пример.рф и é.ñandú@exämple.org"),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_format_coreference_and_kinds(spark):
    out = by_id(op6_pii.replace_pii(table(spark, MIXED)))
    text = {k: r["text"] for k, r in out.items()}
    for k, original in MIXED:
        if original:
            assert re.sub(r"\w", "x", original) == re.sub(r"\w", "x", text[k]) or k in (1, 5, None)
    mails = re.findall(r"\S+@\S+", text[1] + " " + text[2])
    assert mails[0].lower() == mails[1].lower() == mails[2].lower().strip(";") and mails[1].isupper() and mails[0] != "anna.b-7@Mail3.Example.com"
    assert mails[0].endswith(".com")
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", text[1]) + re.findall(r"\d+\.\d+\.\d+\.\d+", text[None])
    assert ips[0] == ips[1] != "10.20.30.40" and all(0 < int(x) < 255 for x in ips[0].split("."))
    phones = re.findall(r"\+1 [()\d -]+\d", text[2])
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "10175557713" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"(?:\d{4}[ -]?){3}\d{4}", text[2] + text[3])]
    assert cards[0] == cards[1] != cards[2] and luhn(cards[0]) and cards[0] != "4" + "1" * 15
    assert re.search(r"IBAN DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d\.", text[3]) and "123-45-6789" not in text[3]
    secrets = re.findall(r'"([0-9a-fA-F]{40})"', text[4])
    assert secrets[0] == secrets[1].lower() and secrets[1].isupper() and secrets[0] != "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    assert "hunter2" not in text[4] and "password: " in text[4]
    frau, herr, mrs = (re.search(p, text[5])[1] for p in (r"Frau (\w+)", r"Herr (\w+)", r"Mrs (\w+) \w+"))
    assert frau != "Meier" and herr != "Meier" and frau != herr and mrs.lower() in op6_pii.GIVEN["female"]["latin"]
    assert re.search(r"госпожа [А-Я][а-я]+ и господин [А-Я][а-я]+\.", text[5]) and "Иванов" not in text[5]
    assert text[6] == MIXED[5][1] and out[6]["pii_replaced"] == 0 and text[7] is None and text[8] == ""
    assert re.search(r"^[а-я]+\.[а-я]+@[а-я]+\.рф и \w\.\w{5}\w?@\w+\.org$", text[9]) and "петров" not in text[9]


def test_table_leaves_nothing_and_touches_nothing_else(spark):
    rows = by_id(registry.QUERIES["op6_pii_surrogates"](spark, SF))
    docs = sf_rows("documents")
    pattern = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+\w|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b[0-9a-fA-F]{32,}\b|\b\d{16}\b")
    mapping, changed = {}, 0
    for d in docs:
        old, new = d["text"] or "", rows[d["doc_id"]]["text"] or ""
        a, b = pattern.findall(old), pattern.findall(new)
        assert pattern.split(old) == pattern.split(new) and len(a) == len(b) == rows[d["doc_id"]]["pii_replaced"]
        for x, y in zip(a, b):
            assert x != y and mapping.setdefault(x, y) == y
            changed += 1
    assert changed and len(set(mapping.values())) == len(mapping) and not set(mapping.values()) & set(mapping)


def test_collisions_are_resolved(spark):
    # 30 of the 100 two-digit numbers: 70 are left for their replacements
    people = spark.createDataFrame([("ssn", "", f"{i:02d}") for i in range(30)], "kind string, gender string, entity string")
    made = {r["entity"]: r["made"] for r in op6_pii.surrogates(people, "k", attempts=60).where("made is not null").collect()}
    assert len(made) == 30 and len(set(made.values())) == 30 and not set(made.values()) & set(made)


def test_digit_of_a_secret_is_its_own(spark):
    rows = [(1, "https://x.com/?auth=abcdefghijklmnop&id=3 from 10.20.30.40"), (2, "password=correcthorsebattery;user1 at 10.20.30.40, a.b@c.org"),
            (3, "auth=abcdefghijkl9nop&id=3\x01token: 1bcdefghijklmnop; 10.20.30.40\x01\x02 10.20.30.41")]
    out = by_id(op6_pii.replace_pii(table(spark, rows)))
    ip = re.search(r"from ([0-9.]+)$", out[1]["text"])[1]
    assert out[1]["text"] == rows[0][1].replace("10.20.30.40", ip) and ip != "10.20.30.40" and out[1]["pii_replaced"] == 1
    mail = re.search(r"(\w\.\w@\w\.org)$", out[2]["text"])[1]
    assert out[2]["text"] == rows[1][1].replace("10.20.30.40", ip).replace("a.b@c.org", mail) and mail != "a.b@c.org"
    new = re.fullmatch(r"auth=([a-z]{12}[0-9][a-z]{3})&id=3\x01token: ([0-9][a-z]{15}); ([0-9.]+)\x01\x02 ([0-9.]+)", out[3]["text"]).groups()
    assert new[0] != "abcdefghijkl9nop" and new[1] != "1bcdefghijklmnop" and new[2] == ip != new[3] != "10.20.30.41"


def test_full_formats_get_longer_replacements(spark):
    numbers = [f"{i:02d}" for i in range(100)]
    people = spark.createDataFrame([("ssn", "", x) for x in numbers], "kind string, gender string, entity string")
    made = {r["entity"]: r["made"] for r in op6_pii.surrogates(people, "k", attempts=2).collect()}
    assert sorted(made) == numbers and len(set(made.values())) == 100 and not set(made.values()) & set(numbers)
    mails = [f"{x}@{y}.co" for x in string.ascii_lowercase for y in string.ascii_lowercase]
    new = op6_pii.replace_pii(table(spark, [(1, " ".join(mails))]), attempts=1).first()["text"].split()
    assert len(set(new)) == 676 and not set(new) & set(mails) and all(re.fullmatch(r"[a-z]@[a-z]{2,}\.co", x) for x in new)


def test_figures_are_no_phones(spark):
    text = "up +1.250, +2 500, +3.141, +12 34 and +1 (2) 34; dial +1 (017) 555-7713 or +49 170 1234567 or +4915112345678."
    out = op6_pii.replace_pii(table(spark, [(1, text)])).first()
    assert out["pii_replaced"] == 3 and out["text"].startswith("up +1.250, +2 500, +3.141, +12 34 and +1 (2) 34; dial +1 (")
    assert not re.search("555-7713|1234567|15112345678", out["text"])


def test_long_secrets_and_addresses_are_whole(spark):
    token, late, local = "xY3-" * 150, "abcd" * 100 + "7" + "wxyz" * 5_000, "ab.c" * 100
    rows = [(1, f"token={token} end"), (2, f"auth: {late}, end"), (3, f"mail {local}@x.org end")]
    out = by_id(op6_pii.replace_pii(table(spark, rows)))
    new = [re.fullmatch(p, out[i]["text"])[1] for i, p in ((1, r"token=((?:[a-z][A-Z][0-9]-){150}) end"), (2, r"auth: ([a-z]{400}[0-9][a-z]{20000}), end"),
                                                           (3, r"mail ((?:[a-z]{2}\.[a-z]){100})@[a-z]\.org end"))]
    for old, got in zip((token, late, local), new):
        assert sum(a != b for a, b in zip(old[256:], got[256:])) > len(old[256:]) // 4


def test_same_key_same_answer_other_key_other_answer(spark):
    df = table(spark, MIXED)
    a, b, c = ({r["doc_id"]: r["text"] for r in op6_pii.replace_pii(df, k).collect()} for k in ("one", "one", "two"))
    assert a == b != c


def test_no_python_in_the_plan(spark, capsys):
    op6_pii.replace_pii(table(spark, MIXED)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_cases(spark):
    docs = edge_docs(spark)
    out = op6_pii.surrogate_documents(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.withColumn("n_chars", op6_pii.F.coalesce(op6_pii.F.char_length("text"), "n_chars").cast("long")).collect()))
    assert op6_pii.replace_pii(empty_docs(spark)).count() == 0
    twice = table(spark, [MIXED[1]] * 3).withColumnRenamed("doc_id", "k").withColumn("i", op6_pii.F.lit(1)).withColumn("new", op6_pii.F.lit("c"))
    assert len({r["text"] for r in op6_pii.replace_pii(twice).collect()}) == 1
