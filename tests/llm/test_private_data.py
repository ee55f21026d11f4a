import hashlib
import re
from collections import defaultdict

from tessera.llm import private_data as P

PATTERNS = {"email": r"[\w.+-]+@[\w-]+\.[\w.]*\w", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "ip": r"(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.])", "card": r"(?<!\d)\d{16}(?!\d)", "key": r"AKIA[0-9A-Z]{16}", "hex": r"(?<=[=\"])[0-9a-f]{16,40}"}


def found(text):
    return [(k, x) for k, p in PATTERNS.items() for x in re.findall(p, text or "")]


def test_planted_entities_are_replaced_in_kind(docs):
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in P.private_report(docs).collect()}
    assert set(before) == set(after)
    forward, back = defaultdict(set), defaultdict(set)
    real = {x for t in before.values() for x in found(t)}
    for k, text in before.items():
        a, b = found(text), found(after[k].text)
        assert [x[0] for x in a] == [x[0] for x in b]
        for x, y in zip(a, b):
            forward[x].add(y)
            back[y].add(x)
            assert y not in real
        if not a:
            assert after[k].text == text
    assert forward and all(len(x) == 1 for x in forward.values()) and all(len(x) == 1 for x in back.values())


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_formats(spark):
    text = "Mrs. Anna Smith met Mr Иван Петров; ANNA. Frau ANNA SMITH. +1 (935) 555-0035 or +1 935 555 0035, 4111 1111 1111 1111 and 4111111111111112, A.b@X.org and a.B@x.ORG, token = \"deadbeefdeadbeef\" 10.0.0.1"
    out = P.private_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert luhn(re.search(r"\d{4} \d{4} \d{4} \d{4}", out).group().replace(" ", "")) and not luhn(re.search(r"(?<!\d)\d{16}(?!\d)", out).group())
    a, b = re.findall(r"\+1 \(?\d{3}\)? \d{3}[- ]\d{4}", out)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "19355550035"
    female = re.search(r"Mrs\. (\w+) (\w+)", out).groups()
    assert female[0] in P.NAMES["f"]["latin"] and female[1] in P.FAMILY["latin"]
    assert re.search(r"Frau (\w+ \w+)", out).group(1) == " ".join(female).upper()
    male = re.search(r"Mr (\w+) (\w+)", out).groups()
    assert male[0] in P.NAMES["m"]["cyrillic"] and male[1] in P.FAMILY["cyrillic"]
    e, f = re.findall(r"[\w.]+@[\w.]+\.(?:org|ORG)", out)
    assert e.lower() == f.lower() and e != f and re.search(r'token = "[0-9a-f]{16}"', out)


def test_collisions_are_drawn_again(spark):
    """Many entities, and names from short lists: distinctness must hold."""
    rows = [(k, f"see 10.{k // 250}.{k % 250}.7 and call +1 ({200 + k % 700}) 555-{1000 + k}") for k in range(1500)]
    out = P.private_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({re.search(r"\d+\.\d+\.\d+\.\d+", r.text).group() for r in out}) == 1500
    assert len({re.search(r"\+1.*", r.text).group() for r in out}) == 1500
    short = spark.createDataFrame([(k, f"password={'%08d' % k}") for k in range(300)] + [(1000 + k, f"Mr {n}") for k, n in enumerate(P.FAMILY["latin"] + ["Xylo", "Yarrow", "Zed"])], "doc_id long, text string")
    out = P.private_report(short).collect()
    assert len({r.text for r in out}) == len(out)


def test_odd(odd, none):
    out = P.replace_private(odd, "k")
    assert out.columns == [*odd.columns, "n_entities"]
    assert sorted((str(r[:-1]) for r in out.collect())) == sorted(str(tuple(r)) for r in odd.collect())
    assert P.replace_private(none, "k").collect() == []


def test_a_hundred_thousand_names(spark):
    """Far more than the lists' names."""
    letters = "abcdefghijklmnopqrst"
    names = ["Q" + "".join(letters[k // 20**j % 20] for j in range(4)) for k in range(100_000)]
    units = spark.createDataFrame([("family", "latin", n.lower()) for n in names], "kind string, class string, normal string")
    out = P.assign_surrogates(units, "k").collect()
    assert len(out) == len({r.surrogate.lower() for r in out}) == 100_000
    assert all(any(r.surrogate.startswith(x) for x in P.FAMILY["latin"]) for r in out)


def said(spark, text, key="k"):
    return P.replace_private(spark.createDataFrame([(1, text)], "doc_id long, text string"), key).first().text


def test_coreference(spark):
    """Parts of a name keep their surrogates, whole or alone, and mentions without a title go too."""
    rows = [(1, "Mr John Smith came. Smith's dog saw JOHN SMITH; a smith, Smithson. Mr Smith left."), (2, "Mr Smith and Mrs Smith"), (3, "John Smith")]
    out = {r.doc_id: r.text for r in P.replace_private(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    given, family = re.match(r"Mr (\w+) (\w+) came", out[1]).groups()
    assert given in P.NAMES["m"]["latin"] and family in P.FAMILY["latin"]
    assert out[1] == f"Mr {given} {family} came. {family}'s dog saw {given.upper()} {family.upper()}; a smith, Smithson. Mr {family} left."
    assert out[2] == f"Mr {family} and Mrs {family}"
    assert out[3] == "John Smith"  # no title in this text


def test_one_form_of_a_phone_number(spark):
    a, b, c = said(spark, "+19355550035 / +1 935 555 0035 / +49 (30) 1234-5678").split(" / ")
    assert a == re.sub(r"[^+0-9]", "", b) != "+19355550035" and a.startswith("+1") and b[:3] == "+1 " and c.startswith("+49")


def test_addresses_beyond_ascii(spark):
    out = said(spark, "to josé.núñez@exämple.org and иван@почта.рф now")
    a, b = re.fullmatch(r"to (\S+)@\S+ and (\S+)@\S+ now", out).groups()
    assert re.fullmatch(r"[a-z]{3}[^a-z.][.][a-z][^a-z.][^a-z.][a-z]{2}", a) and a != "josé.núñez"
    assert re.fullmatch(r"[а-я]{4}", b) and b != "иван" and "exämple" not in out and "почта" not in out


def test_the_key_matters_and_stands_in_no_plan(spark):
    key = "it's a \\ key \" of mine"
    text = "Mr John Smith, a@bcd.org"
    assert said(spark, text, key) == said(spark, text, key) != said(spark, text, "another")
    frame = P.replace_private(spark.createDataFrame([(1, text)], "doc_id long, text string"), "tell-nobody-42")
    units = spark.createDataFrame([("email", "", "a@bcd.org")], "kind string, class string, normal string")
    for df in (frame, P.assign_surrogates(units, "tell-nobody-42")):
        assert "tell-nobody-42" not in df._jdf.queryExecution().toString()


def test_forms_without_room_get_longer(spark):
    units = spark.createDataFrame([("email", "", f"{a}@{b}.com") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"], "kind string, class string, normal string")
    out = P.assign_surrogates(units, "k").collect()
    assert len({r.surrogate for r in out}) == 26 * 26 and not {r.surrogate for r in out} & {r.normal for r in out}


def drawn(key, kind, cls, normal, attempt, at):
    """48 bits of the keyed hash, in plain Python."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return int(sha(key + sha(f"{key}|{kind}|{cls}|{normal}|{attempt}|{at}"))[:12], 16)


def test_against_brute_force(spark):
    """Whole texts by plain Python: detection, drawing, collisions, written forms, mentions."""
    key = "brute"
    people = [("Mr", "John Smith"), ("Mrs", "Anna Novak"), ("Herr", "Karl Weber"), ("Ms", "Smith"), ("Mr", "Weber")]
    texts = [f"{t} {n} wrote from 10.0.{k}.7 to u{k}x@host{k}.org, call +1 (200) 555-{1000 + k}. {n.split()[-1]} again." for k, (t, n) in enumerate(people * 8)]
    units = set()
    for k, (t, n) in enumerate(people * 8):
        g = "f" if t in P.FEMALE else "m"
        units |= {("ip", "", f"10.0.{k}.7"), ("email", "", f"u{k}x@host{k}.org"), ("phone", "", f"+1200555{1000 + k}")}
        *given, family = n.lower().split()
        units |= {("family", "latin", family), *(("given", f"{g}-latin", x) for x in given)}

    def draw(unit, attempt, syllables):
        kind, cls, normal = unit
        d = lambda at: drawn(key, kind, cls, normal, attempt, at)
        if kind in ("family", "given"):
            names = P.FAMILY["latin"] if kind == "family" else P.NAMES[cls[0]]["latin"]
            tail = "".join(P.SYLLABLES["latin"][d(2000 + k) % 20] for k in range(1, syllables + 1))
            return names[d(0) % len(names)] + tail
        if kind == "ip":
            return ".".join(str(d(i) % 254 + 1) for i in range(4))
        fixed = len(normal) - len(normal.rsplit(".", 1)[-1]) if kind == "email" else None
        out = ""
        for i, c in enumerate(normal):
            keep = i >= fixed if kind == "email" else i < 2
            out += c if keep or not c.isalnum() else "0123456789"[d(i) % 10] if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"[d(i) % 26]
        return out

    want, todo, attempt, taken = {}, sorted(units), 0, {(k, n) for k, _, n in units}
    while todo:
        syllables = P.syllables_for(len(todo), attempt)
        made = {u: draw(u, attempt, syllables) for u in todo}
        for u in todo:
            mine = (u[0], made[u].lower())
            if mine not in taken and u == min(v for v in todo if (v[0], made[v].lower()) == mine):
                want[u] = made[u]
        taken |= {(u[0], x.lower()) for u, x in want.items()}
        todo, attempt = [u for u in todo if u not in want], attempt + 1
    out = {r.doc_id: r.text for r in P.replace_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key).collect()}
    for k, (t, n) in enumerate(people * 8):
        g = "f" if t in P.FEMALE else "m"
        *given, family = n.lower().split()
        name = " ".join([*(want["given", f"{g}-latin", x] for x in given), want["family", "latin", family]])
        phone = want["phone", "", f"+1200555{1000 + k}"]
        assert out[k] == f"{t} {name} wrote from {want['ip', '', f'10.0.{k}.7']} to {want['email', '', f'u{k}x@host{k}.org']}, call +1 ({phone[2:5]}) {phone[5:8]}-{phone[8:]}. {name.split()[-1]} again."
