"""Base kinds against a plain reading of their patterns; discovery on planted contexts."""

import random
import re

from pyspark.sql import functions as F

from turnwise.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, r, ok in rules for m in re.finditer(r, text or "") if ok(m[0])]


def test_base_spans(spark, docs):
    rng = random.Random(7)
    bits = ["a.b", "@", "x", "1", "23", "255", ".", "-", " ", "+", "(", "é🙂", "com", "4539578763621486", "\n", "_", "00", "192.168.0.1", "+1 (555) 555-1234"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "a@b.com_x@d.org", "4539 5787 6362 1486", "4539578763621487", "1.2.3.4.5.6.7.8", "007.1.2.3", "+" * 300, "1" * 5000, "a" * 50_000 + "@", "1." * 20_000, "@" * 5000]
    rows = list(enumerate(texts))
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.personal_data(docs(rows, extra=True)).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_very_many_matches_in_one_text(docs):
    text = "u@a.b " * 2000
    (row,) = pii.personal_data(docs([(1, text)])).collect()
    assert [tuple(s) for s in row.base] == plain(text)


def planted():
    """A label that stands before e-mails and, with the same shape of its own, before account ids."""
    rows = [(i, f"Some text here. contact: user{i}@mail.example.com and more") for i in range(40)]
    rows += [(100 + i, f"Other text. contact: ACCT{i}X77 is open") for i in range(3)]
    rows += [(200 + i, f"the {i}th number {i * 7919 + 10000} of the list") for i in range(30)]
    return rows


def test_discovers_by_context_and_leaves_others_alone(docs):
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(docs(planted())).collect()}
    for i, text in planted():
        context = [text[s:e] for k, s, e in got[i] if k == "context"]
        assert context == ([f"ACCT{i - 100}X77"] if 100 <= i < 200 else [])
        assert [x for x in got[i] if x[0] != "context"] == plain(text)


def test_repeated_rows_empty_table_and_masks(spark, docs):
    rows = [(1, "mail a@b.com now"), (1, "mail a@b.com now"), (None, "ip 10.0.0.1"), (2, None), (3, "clean")]
    assert pii.personal_data(docs(rows)).count() == 5
    assert pii.personal_data(docs([])).count() == 0
    masked = sorted((str(r.doc_id), r.text) for r in pii.masked(docs(rows, extra=True)).collect())
    assert masked == sorted([("1", "mail <EMAIL> now")] * 2 + [("None", "ip <IP>"), ("2", None), ("3", "clean")], key=lambda r: (r[0], r[1] or ""))
    over = pii.masked(docs([(1, "x 1.2.3.4@9.9.9.9 y")])).select(F.col("text")).first()[0]
    assert over == "x <EMAIL> y"


def contexts(docs, rows):
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(docs(rows)).collect()}
    return {i: {text[s:e] for k, s, e in got[i] if k == "context"} for i, text in rows}


def test_seeds_of_any_form_support_their_pattern(docs):
    """E-mails without digit, cards and phones in groups; tokens that are glued to their label, short or long."""
    name = lambda i: "".join(chr(97 + int(c)) for c in str(1000 + i))
    long = "Z9" * 60
    rows = [(i, f"see member: {name(i)}@example.com today") for i in range(60)]
    rows += [(100 + i, f"card {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} is old") for i, c in enumerate(cards(30))]
    rows += [(200 + i, f"please call <+1 (555) 55{i:02d}-1234>") for i in range(30)]
    rows += [(300 + i, f"the ref:{name(i)}@example.org there") for i in range(60)]
    planted = {400: ("member: M-12345 x", {"M-12345"}), 401: ("a member: K7", {"K7"}), 402: (f"member: {long} y", {long}), 403: ("card X99", {"X99"}), 404: ("call 555-12", {"555-12"}), 405: ("my ref:AB1234 x", {"AB1234"}), 406: ("number 12 of member: list", set())}
    rows += [(i, text) for i, (text, _) in planted.items()]
    got = contexts(docs, rows)
    assert {i: v for i, v in got.items() if v} == {i: v for i, (_, v) in planted.items() if v}


def cards(n):
    whole = [f"4539{i:011d}{d}" for i in range(n) for d in range(10)]
    return [c for c in whole if luhn(c)]


def test_rounds_until_nothing_new(docs):
    """A chain of patterns, each known only by what the one before it discovers."""
    rows = [(i, f"p: u{i}@mail.example") for i in range(90)]
    for step in range(6):
        label = ("p", "q", "r", "s", "t", "v", "w")
        rows += [(1000 + 10 * step + i, f"{label[step]}: {step}N{i}") for i in range(5)]
        rows += [(2000 + 100 * step + 20 * i + k, f"{label[step + 1]}: {step}N{i}") for i in range(5) for k in range(20)]
    rows += [(3000, "w: LAST1")]
    assert contexts(docs, rows)[3000] == {"LAST1"}


def test_long_words_and_many_tokens_are_cheap(docs):
    texts = ["a" * 300_000 + "1", "a:" * 100_000 + "1", "x. " * 60_000 + "9", "k: v1 " * 3000, "." * 200_000 + "1"]
    assert pii.personal_data(docs(list(enumerate(texts)))).count() == len(texts)


# --- the whole discovery against a plain version ------------------------------------


def plain_words(text):
    text = re.sub(r"(?<!\S)[^\w\s]+(?=\S)", "", text.lower())
    return re.sub(r"[\x20\t]+", " ", re.sub("[0-9]+", "9", text))


def plain_nodes(text, spans):
    """(start, end, patterns, seed) of seeds and tokens; ASCII punctuation only."""
    punct = r"!-/:-@\[-`{-~"
    nodes = []

    def patterns(left, right):
        w, f = left.split(" ") if left else [], right.split(" ") if right else []
        out = [" ".join(w[-n:]) + " _" for n in (1, 2, 3) if len(w) >= n]
        if w and f:
            out.append(f"{w[-1]} _ {f[0]}")
        if len(f) >= 2:
            out.append("_ " + right)
        return out

    def sides(matches, i):
        s, e = matches[i]
        before = text[matches[i - 1][0] if i else 0 : s]
        after = text[e : matches[i + 1][1] if i + 1 < len(matches) else len(text)]
        flipped = re.match(rf"(?:[\x20\t]|(?![:=#])[{punct}])*([^\s]+(?:[\x20\t]+[^\s]+){{0,2}})?", before[::-1])
        # Possessive: what the first part has passed over isn't given back.
        left = plain_words((flipped[1] or "")[::-1])
        follows = re.match(rf"[\x20\t{punct}]*([^\s]+(?:[\x20\t]+[^\s]+)?)?", after)
        return left, re.sub(rf"(?<=\S)[{punct}]+(?!\S)", "", plain_words(follows[1] or ""))

    longest = {}
    for kind in pii.KINDS:
        raw = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9]){15,}", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}[kind]
        matches = [m.span() for m in re.finditer(raw, text)]
        for i, (s, e) in enumerate(matches):
            if (kind, s, e) in spans:
                longest.setdefault(s, []).append((-e, text[s:e], sides(matches, i)))
    for s, found in longest.items():
        back, value, (left, right) = min(found)
        nodes.append((s, -back, patterns(left, right), True))
    matches = [m.span() for m in re.finditer(r"\S+", text) if re.search("[0-9]", m[0])]
    for i, (s, e) in enumerate(matches):
        left, right = sides(matches, i)
        mine = [(s, e, patterns(left, right), False)]
        m = re.match(r"([^\s]*[:=#])[^\s0-9]*[0-9]", text[s:e])
        if m and re.search("[a-zA-Z]", m[1]):
            mine.append((s + len(m[1]), e, patterns((left + " " + plain_words(m[1])).strip(), right), False))
        nodes += [n for n in mine if not any(b[1] < n[1] and b[2] > n[0] for b in spans)]
    return nodes


def plain_discovery(rows):
    """doc: spans that patterns discover."""
    occurrences = [(i, s, e, text[s:e], p, seed) for i, text in rows for s, e, p, seed in plain_nodes(text, plain(text))]
    edges, seeds = {}, set()
    for _, _, _, value, patterns, seed in occurrences:
        for p in patterns:
            edges[p, value] = edges.get((p, value), 0) + 1
            if seed:
                seeds.add((p, value))
    known = set(seeds)
    specific = lambda v: bool(re.search("[A-Za-z]", v)) or len(re.sub("[^0-9]", "", v)) >= pii.SPECIFIC
    while True:
        total, sure, support = {}, {}, {}
        for (p, v), n in edges.items():
            total[p] = total.get(p, 0) + n
            if (p, v) in known:
                sure[p], support[p] = sure.get(p, 0) + n, support.get(p, 0) + 1
        good = {p for p in sure if support[p] >= pii.SUPPORT and sure[p] / (total[p] + pii.SMOOTHING) >= pii.ACCEPT}
        accepted = {(p, v) for p, v in edges if p in good} - known
        if not accepted:
            break
        values = {v for _, v in accepted if specific(v)}
        known |= accepted | {(p, v) for p, v in edges if v in values}
    values = {v for p, v in known - seeds if specific(v)}
    out = {i: set() for i, _ in rows}
    for i, s, e, v, patterns, seed in occurrences:
        if not seed and (good.intersection(patterns) or v in values):
            out[i].add((s, e))
    return out


def test_discovery_equals_a_plain_version(docs):
    rng = random.Random(11)
    labels = ["member:", "my id is", "call me at", "ref", "order no.", "the", "in", "account holder:"]
    tails = ["thanks", "is my contact", "for details", "and more", ""]

    def value(label):
        kind = rng.random()
        known = {"member:": 0.97, "my id is": 0.95, "call me at": 0.96, "account holder:": 0.9}.get(label, 0.05)
        if kind < known:
            return rng.choice([f"u{rng.randint(1, 500)}@mail.example", f"10.0.{rng.randint(0, 255)}.{rng.randint(0, 255)}", f"+1 555 {rng.randint(1000000, 9999999)}"])
        return rng.choice([f"AC{rng.randint(1, 60)}X", str(rng.randint(1, 40)), f"{rng.randint(1, 20)}234567", f"id:{rng.randint(1, 30)}Q"])

    rows = []
    for i in range(900):
        parts = []
        for _ in range(rng.randint(1, 3)):
            label = rng.choice(labels)
            parts.append(f"we say {label} {value(label)} {rng.choice(tails)}")
        rows.append((i, rng.choice(["; ", "\n", " "]).join(parts)))
    expected = plain_discovery(rows)
    assert sum(map(len, expected.values())) > 50
    got = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "context"} for r in pii.personal_data(docs(rows)).collect()}
    assert got == expected


def test_patterns_of_several_words_and_after_the_instance(docs):
    """Neither the word before alone nor the word after alone tells; two words before, or after, do."""
    name = lambda i: "".join(chr(97 + int(c)) for c in str(1000 + i))
    rows = [(i, f"reach me via {name(i)}@example.com or not") for i in range(40)]
    rows += [(100 + i, f"ship it via route {i + 3} or via {i + 70}") for i in range(40)]
    rows += [(200 + i, f"seen {name(i)}@example.org joined today") for i in range(40)]
    rows += [(300 + i, f"seen {i + 5} joined parts") for i in range(40)]
    planted = {400: ("reach me via ID77K please", {"ID77K"}), 401: ("here X5Y joined today", {"X5Y"}), 402: ("went via K12 then", set()), 403: ("the 31 joined parts", set())}
    rows += [(i, text) for i, (text, _) in planted.items()]
    got = contexts(docs, rows)
    assert {i: v for i, v in got.items() if v} == {i: v for i, (_, v) in planted.items() if v}


def test_short_numbers_don_t_carry_a_pattern_on(docs):
    """A number accepted after a good pattern is not accepted where that pattern doesn't stand."""
    rows = [(i, f"contact: u{i}@mail.example") for i in range(90)] + [(100, "contact: 2024")]
    rows += [(200 + i, f"in the year 2024 of {i}00") for i in range(30)]
    got = contexts(docs, rows)
    assert got[100] == {"2024"} and not any(got[200 + i] for i in range(30))


def test_columns_of_the_same_names_stay(docs):
    clash = docs([(1, "mail a@b.com now"), (2, None)])
    for name in ("pii_key", "pii_spans", "key", "base", "candidates", "more"):
        clash = clash.withColumn(name, F.lit("mine"))
    out = pii.masked(clash)
    assert out.columns == clash.columns
    assert {(r.text, r.pii_key, r.pii_spans) for r in out.collect()} == {("mail <EMAIL> now", "mine", "mine"), (None, "mine", "mine")}
    assert pii.masked(docs([])).count() == 0
