import re

from tickloom.llm import pii


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 97, 1000, 1025):
        assert sorted(pii.permute(x, n, b"t", b"k") for x in range(n)) == list(range(n))
    assert len({pii.permute(x, 10**16, b"t", b"k") for x in range(2000)}) == 2000


def test_values_stay_valid_and_linked():
    text = 'Call +1 (922) 555-5862 or mail bosbt.42@mail8.example.com, pay 4111111111111111### from GB82 WEST 1234 5698 7654 32 at 42.144.35.254, born 1984-02-29, 31.12.1999, ssn 123-45-6789, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password=b7db7aa4a5fcc78305.'
    new, found = pii.pseudonymise(text)
    assert found == {"email": 1, "secret": 2, "iban": 1, "card": 1, "ip": 1, "ssn": 1, "phone": 1, "date": 2}
    assert pii.pseudonymise("x " + text + " y")[0] == "x " + new + " y" and len(re.findall(r"\d{4}-\d{2}-\d{2}", new)) == 1
    for private in ("922) 555-5862", "bosbt.42@", "42.144.35.254", "1984-02-29", "31.12.1999", "123-45-6789", "24be64439e", "b7db7aa4a5", "WEST 1234"):
        assert private not in new
    again, n = pii.pseudonymise(new)
    assert n == found  # pseudonyms are valid values themselves
    for plain in ("no numbers here", "4041894974608796 is no card", "999.1.1.1", "2020-13-45", "version 2.0.1 of 3", "key: value", ""):
        assert pii.pseudonymise(plain) == (plain, {})


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "10.0.0.1", 7), (3, "10.0.0.1", 7)], "doc_id long, text string, n_ip int")
    rows = pii.pseudonymise_documents(df).collect()
    assert {r.doc_id: r.n_ip for r in rows} == {1: 0, 2: 0, 3: 1} and rows[0].text is None and rows[2].text == rows[3].text != "10.0.0.1"
    assert pii.op6_pii_pseudonyms(df.limit(0)).count() == 0


def test_failed_candidates_hide_no_value():
    hidden = {
        "pay BE68 5390 0754 7034 USD now": ("iban", "5390 0754"), "pay BE68539007547034 2024": ("iban", "BE68539007547034"), "AT61 1904 3002 3457 3201 EUR 100": ("iban", "1904 3002"),
        "AB12 BE68 5390 0754 7034": ("iban", "5390 0754"), "password: longusername@example.com": ("email", "longusername"), "2024 4111 1111 1111 1111": ("card", "4111 1111 1111 1111"),
        "on 3/7/2021 and": ("date", "3/7/2021"), "on 2021-3-17 and": ("date", "2021-3-17"), "XX00 ABCD 1234 call 555-123-4567": ("phone", "555-123-4567"),
    }
    for text, (kind, private) in hidden.items():
        new, found = pii.pseudonymise(text)
        assert found == {kind: 1} and private not in new and len(new) == len(text), text
        assert pii.pseudonymise(new)[1] == found
    assert pii.pseudonymise("BE68 5390 0754 7034 USD")[0][:19] == pii.pseudonymise("BE68 5390 0754 7034")[0]
    for plain in ("1234 5678 9012 3456", "BE68 5390 0754 7035 USD", "13/32/2021", "token=" * 30_000 + "x"):
        assert pii.pseudonymise(plain) == (plain, {})


def test_digits_of_all_scripts():
    text = "a1 ٩٢٢-٥٥٥-٥٨٦٢ ٤٢.١٤٤.٣٥.٢٥٤"
    new, found = pii.pseudonymise(text)
    assert found == {"phone": 1, "ip": 1} and "٥٥٥" not in new and not re.search("[0-9]", new[2:])
    plain = text.translate({0x660 + d: str(d) for d in range(10)})
    assert new.translate({0x660 + d: str(d) for d in range(10)}) == pii.pseudonymise(plain)[0]


def test_unpadded_dates_are_permuted():
    days = [f"{m}/{d}/2021" for m in range(1, 10) for d in range(1, 10)]
    got = [pii.pseudonymise(d)[0] for d in days]
    assert sum(a != b for a, b in zip(days, got, strict=True)) > 70
    assert len(set(got)) == len(days) and all(re.fullmatch(r"[1-9]/[1-9]/\d{4}", d) for d in got)


def test_slash_dates_are_injective():
    import datetime as dt

    days = [dt.date(1950, 1, 1) + dt.timedelta(k) for k in range(0, 29_000, 7)]
    values = {d.strftime(f) for d in days for f in ("%m/%d/%Y", "%d/%m/%Y")}
    got = {v: pii.pseudonymise(v)[0] for v in values}
    assert len(set(got.values())) == len(values) and all(pii.pseudonymise(x)[1] == {"date": 1} for x in got.values())


def test_addresses_beyond_ascii_and_long_ones():
    for value in ("ülrich@example.com", "李伟@example.com", "иван.п@пример.рф", "a@xn--e1afmkfd.xn--p1ai", "x" * 90 + "@example.com", "bob@" + "a." * 12 + "com"):
        new, found = pii.pseudonymise(f"to {value}.")
        local = value.split("@")[0]
        assert found == {"email": 1} and not new.startswith(f"to {local}@") and new.endswith(value.split("@")[1] + ".") and len(new) == len(value) + 4
        assert pii.pseudonymise(new)[1] == found


def test_phones_in_other_digits_beside_ascii_ones():
    new, found = pii.pseudonymise("room 7, ٠٣٠-١٢٣-٤٥٦٧")
    assert found == {"phone": 1} and "١٢٣" not in new


def test_against_a_plain_version(spark):
    """Values planted among words: each is replaced by its own rule's value, and nothing else changes."""
    import random

    rnd = random.Random(6)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    made = {
        "card": lambda: (lambda b: b + pii.luhn_digit(b))("4" + digits(14)),
        "ip": lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
        "ssn": lambda: f"{rnd.randrange(1, 666):03d}-{rnd.randrange(1, 100):02d}-{rnd.randrange(1, 10_000):04d}",
        "phone": lambda: f"+{rnd.randrange(1, 99)} ({rnd.randrange(200, 999)}) 555-{digits(4)}",
        "date": lambda: f"{rnd.randrange(1900, 2100)}-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}",
        "email": lambda: "".join(rnd.choice("abcdef.")for _ in range(9)).replace(".", "x.y") + "@mail.example",
    }
    texts, want = [], []
    for _ in range(200):
        parts = [(rnd.choice(list(made)), None) if rnd.random() < 0.3 else ("", rnd.choice(["so", "9 lives", "v2.1", "(a)", "x-1", "100%", "no. 5,"])) for _ in range(rnd.randrange(20))]
        parts = [(k, made[k]() if k else w) for k, w in parts]
        texts.append(" word ".join(w for _, w in parts))
        want.append(" word ".join(pii.RULES[k](w, pii.KEY) if k else w for k, w in parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.op6_pii_pseudonyms(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
