"""URL filter: rules against a plain reading, the template tree against a plain tree in Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnwise.llm import urls

PAGES = "page_id long, url string, html string"


def plain_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = max((r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


ODD_URLS = [None, "", "no scheme", "http://", "http://H.Example.COM/de/1?x#y", "https://a.net", "https://a.net/", "https://example.net/en/1", "https://www.example.net/en/", "x://org/fr/", "http://notexample.com/de/", "http://É.net/a", "a://b.org/fr/x://c", "http://e.org/" + "s/" * 3000, "http://x.com/\n/y", "http://x.com//a//"]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "") for i, u in enumerate(ODD_URLS)] + [(4, ODD_URLS[4], ""), (None, "http://q.com/1", "")]
    got = urls.judged(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            host, path, rule, verdict = plain_url(ODD_URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.judged(spark.createDataFrame([], PAGES)).count() == 0


def general(x):
    for pattern, name in (
        (r"[0-9]+", "{n}"),
        (r"[0-9]+\.([A-Za-z]{1,5})", "{n}.%s"),
        (r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "{date}"),
        (r"(?=.*[0-9])[0-9a-fA-F-]{8,}", "{id}"),
        (r"(?=.*[0-9])[A-Za-z0-9_.~%-]{12,}", "{slug}"),
    ):
        if m := re.fullmatch(pattern, x):
            return name % m[1] if "%s" in name else name
    return x


def likelihood(n, b):
    return sum(x * math.log(x / n) for x in (b, n - b) if x > 0)


def plain_verdicts(pages, labels=None):
    """page: (verdict, purity, n_labelled), by a tree of dictionaries."""
    labels, rows, seen = labels or {}, [], defaultdict(list)
    for page, url in pages:
        host, path, rule, verdict = plain_url(url)
        bad = {"block": 1, "allow": 0}.get(verdict, labels.get(page))
        branch = tuple(general(x) for x in re.sub("^/", "", path).split("/"))
        ruled = max(rule.split("/", 1)[1].count("/"), 0) if rule else 0
        rows.append((page, host, branch, verdict))
        seen[host, url, branch].append((bad, ruled))
    branches = defaultdict(lambda: [0, 0, 0.0, 0])
    for (host, _, branch), found in seen.items():
        known = [b for b, _ in found if b is not None]
        got = branches[host, branch]
        got[0] += 1
        got[1] += bool(known)
        got[2] += sum(known) / len(known) if known else 0
        got[3] = max(got[3], *(r for _, r in found))
    children, total, fixed = Counter(), Counter(), set()
    for (host, branch), (n, _, _, ruled) in branches.items():
        for i in range(len(branch)):
            children[host, branch[:i], branch[i]] += n
            total[host, branch[:i]] += n
            if i < ruled:
                fixed.add((host, branch[:i], branch[i]))
    rare = {c for c, n in children.items() if n * urls.DIFFERENT <= total[c[:2]] and c not in fixed}
    share = Counter()
    for c in rare:
        share[c[:2]] += children[c]
    name = lambda h, b: tuple("*" if (h, b[:i], b[i]) in rare and share[h, b[:i]] >= urls.VARIES * (total[h, b[:i]] + urls.DIFFERENT) else b[i] for i in range(len(b)))
    template, counts, below = {}, defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for (host, branch), (_, n, bad, _) in branches.items():
        t = template[host, branch] = name(host, branch)
        for d, key in [(counts, (host, t)), *((below, (host, t[:i])) for i in range(len(t) + 1))]:
            d[key][0] += n
            d[key][1] += bad
    families, family = defaultdict(Counter), {}
    for (host, t), (n, bad) in counts.items():
        at = [i for i, x in enumerate(t) if not re.fullmatch(r"\{.*|\*|", x)]
        last = at[-1] if at else -1
        family[host, t] = (host, t[:last] + ("<>",) + t[last + 1 :] if at else t), max(last, 0)
        families[family[host, t][0]][n, bad] += 1
    part = {}
    for f, pairs in families.items():
        groups = []
        for (n, b), m in sorted(pairs.items(), key=lambda x: (-x[0][1] / max(x[0][0], 1), -x[0][0])):
            if not n:
                continue
            if groups:
                n0, b0 = groups[-1][-1][1]
                alike = 2 * (likelihood(n0, b0) + likelihood(m * n, m * b) - likelihood(n0 + m * n, b0 + m * b)) <= urls.ALIKE
            if groups and alike:
                groups[-1].append(((n, b), (m * n, m * b)))
            else:
                groups.append([((n, b), (m * n, m * b))])
        for g in groups:
            whole = tuple(sum(x[1][i] for x in g) for i in (0, 1))
            for pair, _ in g:
                part[f, pair] = whole
        if len(groups) == 1:
            part[f, (0, 0)] = whole
    n = sum(b[1] for b in branches.values())
    prior = (sum(b[2] for b in branches.values()) + urls.STRENGTH * urls.PRIOR) / (n + urls.STRENGTH)
    out = {}
    for page, host, branch, verdict in rows:
        t = template[host, branch]
        f, last = family[host, t]
        chain = [below[host, t[:i]] for i in range(last + 1)] + [part.get((f, tuple(counts[host, t])), (0, 0))]
        p, purity, support = prior, None, 0
        for n, b in chain:
            if n:
                p = (b + urls.STRENGTH * p) / (n + urls.STRENGTH)
                if n >= urls.LABELLED:
                    purity, support = p, n
        bad = support >= urls.LABELLED and purity >= urls.THRESHOLD
        out[page] = verdict or ("block" if bad else "allow"), p if purity is None else purity, support
    return out


def random_pages(seed):
    rng = random.Random(seed)
    hosts = ["a.example.com", "b.example.com", "c.org", "d.net", "shop.io", "example.net"]
    out = []
    for i in range(900):
        host = rng.choice(hosts)
        first = rng.choice(["en", "de", "fr", "es", "ads", f"user{rng.randint(0, 300)}", "help", ""])
        rest = [rng.choice(["x", "list", str(rng.randint(1, 99)), "2024-01-02", f"item-{rng.randint(1, 9999):08d}", "p.html", f"{i}.html"]) for _ in range(rng.randint(0, 3))]
        out.append((i, f"https://{host}/" + "/".join([first, *rest]) + rng.choice(["", "?q=1", "#t"])))
    out += [(2000 + i, u) for i, (_, u) in enumerate(out[:50])]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_a_plain_tree(spark, seed):
    rng = random.Random(seed + 50)
    pages = random_pages(seed)
    known = {i: rng.random() < (0.9 if "ads" in u or "b.example" in u else 0.1) for i, u in pages if rng.random() < 0.15}
    labels = spark.createDataFrame([(k, v) for k, v in known.items()], "page_id long, bad boolean") if seed else None
    got = urls.judged(spark.createDataFrame([(*p, "") for p in pages], PAGES).repartition(5), labels=labels).collect()
    expected = plain_verdicts(pages, {k: int(v) for k, v in known.items()} if seed else None)
    assert len(got) == len(pages)
    for r in got:
        verdict, purity, n = expected[r.page_id]
        assert r.n_labelled == n and r.purity == pytest.approx(purity, abs=1e-9)
        assert r.verdict == verdict or abs(purity - urls.THRESHOLD) < 1e-9
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_labels_flow_through_the_tree(spark):
    """Unlabelled pages take the purity of the nearest place with labels; too few labels judge nothing."""
    rows = [(i, f"http://spam.com/offers/{i}/buy", "") for i in range(8)] + [(50, "http://spam.com/other/place", "")]
    rows += [(100 + i, f"http://good.com/docs/{i}", "") for i in range(8)] + [(150, "http://good.com/blog/x", "")]
    rows += [(200, "http://new.com/a/1", ""), (201, "http://new.com/b/2", "")]
    rows += [(300 + i, f"http://mixed.com/{'bad' if i < 8 else 'fine'}/{i}", "") for i in range(16)] + [(350, "http://mixed.com/third/77", "")]
    marks = [(i, True) for i in range(5)] + [(100 + i, False) for i in range(5)] + [(200, True)] + [(300 + i, i < 8) for i in range(16) if i % 8 < 6]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, PAGES), labels=spark.createDataFrame(marks, "page_id long, bad boolean")).collect()}
    assert got[7].verdict == got[50].verdict == "block"
    assert got[107].verdict == got[150].verdict == "allow"
    assert got[201].verdict == "allow" and got[201].n_labelled == 0
    assert got[307].verdict == "block" and got[315].verdict == "allow"
    assert got[350].verdict == "allow" and got[350].n_labelled == 12  # the host's root: half of it is bad


@pytest.mark.parametrize("each", [1, 12])
def test_templates_do_not_depend_on_size(spark, each):
    """The same site crawled deeper, with repeated rows; a rare segment of a rule; paths that differ deep down."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(1000 + i))
    rows, labelled = [], []
    for u in range(40):
        for k in range(each):
            rows.append((1000 * u + k, f"http://shop.org/{word(u)}/{'abcdefghijkl'[k]}/spam", ""))
            if u < 10:
                labelled.append((1000 * u + k, True))
    rows += [(90_000, "http://shop.org/fr/spam", "")]
    deep = "http://deep.com/a/b/c/d/e/f/"
    rows += [(91_000 + i, f"{deep}{'ads' if i < 20 else 'help'}/{i}", "") for i in range(40)]
    labelled += [(91_000 + i, i < 20) for i in (*range(6), *range(20, 26))]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows + rows, PAGES), labels=spark.createDataFrame(labelled, "page_id long, bad boolean")).collect()}
    assert all(got[1000 * u].verdict == "block" for u in range(40))
    assert got[90_000].template != got[0].template and got[90_000].verdict == "allow"
    assert {got[91_000 + i].verdict for i in range(20)} == {"block"} and {got[91_000 + i].verdict for i in range(20, 40)} == {"allow"}
