import hashlib
import random
import re


from cohortframe.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            n = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(df):
    rows = pii.personal_data(df).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        want = base(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k + ":") for x in want) for k in RULES), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_added
    return rows


def test_documents(documents):
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in check(documents)) > 20


def test_odd_texts(spark):
    rng = random.Random(6)
    parts = ["a", "b.c", "@", ".", "..", "-", " ", "  ", "+", "+1", "12", "255", "256", "000255", "4111 1111 1111 1111", "4111-1111-1111-1111", "(", ")", "1.2.3.4", "x@y.z", "é", "😀", "\n", "_", "%", "", ""]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    texts += ["a@b.c_d@e.f", "a@b.co@c.de", "1.2.3.4.5.6.7.8", "+1 2345 6789.", "+1 .......", "x@y.", "@y.z", "++12345678", "1" * 40, "5" * 16 + " " + "5" * 16]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_cards_of_single_digits(spark):
    card = "4111111111111111"
    texts = [" ".join(card), "-".join(card), f"pay {' '.join(card)} now", f"{' '.join(card)} and 12"]
    rows = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.n_card for r in rows] == [1] * 4


def test_very_long_runs(spark):
    address = "x@" + "y." * 30_000 + "z"
    cases = {
        "1" * 300_000: "", "1 " * 60_000: "", "a" * 300_000 + "@b.c": "email:0:300004", address: f"email:0:{len(address)}",
        "+1" + "." * 200_000: "", "9.9." * 6_000: ",".join(f"ip:{8 * k}:{8 * k + 7}" for k in range(3_000)), "a" * 200_000: "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r.spans for r in pii.personal_data(df).orderBy("doc_id").collect()] == list(cases.values())


def test_added_spans_need_support(spark):
    rng = random.Random(5)
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    rows = []
    for k in range(60):
        rows.append((k, f"please call {number(3)} {number(3)} {number(4)} today"))
        rows.append((100 + k, f"write to user{k} at mail{k} dot com soon"))
        rows.append((200 + k, f"token = \"{number(10)}\" and order {number(9)} here, id {number(8)}"))
        rows.append((300 + k, f"user{k}@mail.example.com, +1 (555) {number(3)}-{number(4)}"))
    found = {r.doc_id: r for r in check(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert all(found[k].n_added == 1 and found[k].spans.startswith("phone:12:") for k in range(60))
    assert all(found[100 + k].n_added == 1 and found[100 + k].spans.startswith("email:9:") for k in range(60))
    assert all(found[200 + k].n_added == 0 and found[300 + k].n_added == 0 for k in range(60))


def test_clean_text_has_no_spans(spark):
    rows = [(k, "The number 1234567 in a list, 3.14 or 1,000,000 of 2024-01-01; version 10.2.1, at a dot in time") for k in range(30)]
    assert all(r.spans == "" for r in check(spark.createDataFrame(rows, "doc_id long, text string")))


def test_edges(edge, empty):
    rows = pii.personal_data(edge).collect()
    assert len(rows) == edge.count()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_phone) for r in rows}[8] == (1, 1, 1)
    assert all(r.spans == "" for r in rows if r.doc_id != 8)
    assert pii.personal_data(empty).count() == 0


def test_reliabilities_follow_the_votes():
    chance = pii.reliabilities([("phone", 1, 1, 1, 90), ("phone", -1, -1, -1, 80), ("phone", -1, 0, 1, 40), ("phone", 1, 0, 1, 30)])
    assert chance["phone", 1, 1, 1] > 0.99 and chance["phone", 1, 0, 1] > 0.9 and chance["phone", -1, -1, -1] < 0.01
