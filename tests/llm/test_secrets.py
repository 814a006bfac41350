"""Base patterns against a plain reading of them; the lexer on sources and configurations."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.llm import secrets

KEY = "f3A9c27Qx81LmZ04vTrB"


def plain(text):
    out = []
    for kind, pattern, ok in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        out += [(m.start(), secrets.KINDS.index(kind), kind, m.end()) for m in re.finditer(pattern, text, re.A) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "API_KEY", "apikey", "=", ": ", '"', "'", " ", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "x", "é", "\n", "ſecret", "pa", "sswd"]), max_size=14).map("".join))
def test_base_patterns(text):
    assert [x[:3] for x in secrets.scan(text) if x[0] != "lexed"] == plain(text)


def lexed(text):
    return [text[s:e] for k, s, e, _ in secrets.scan(text) if k == "lexed"]


@pytest.mark.parametrize(
    "text",
    [
        f'db_pwd = "{KEY}"',
        f"private-key: '{KEY}'",
        f'{{"accessKey": "{KEY}"}}',
        f"export DB_PASSPHRASE={KEY}",
        f"clientCredentials := {KEY}!",
        f"--auth-bearer={KEY}",
        f"K = '{KEY}'\nlogin(db_pwd=K)",
        f"a = '{KEY}'\nb = a\nc = b\nbearer = c",
        f"credential => '{KEY}'",
        f'credential = """\n  first line\n  {KEY}\n"""',
        f"bearer: |\n  {KEY}\n  more\nnext: 1",
        f"signing-key: >-\n\t{KEY}",
        f"{'x' * 400}_db_pwd = '{KEY}'",
    ],
)
def test_finds(text):
    assert any(KEY in found for found in lexed(text))


def test_joined_parts_are_found():
    text = 'p1 = "aZ81kQ02mX"\np2 = "77vTrB19sd"\nbearer = p1 + p2'
    assert lexed(text) == ["aZ81kQ02mX", "77vTrB19sd"]


@pytest.mark.parametrize(
    "text",
    ["Note: this is prose, said: nobody.", 'colour = "f3A9c27Qx81LmZ04vTrB"', 'db_pwd = "changeme123"', 'db_pwd = "${DB_PASSWORD}"', "pwd == other", "https://host/path?x=1", "", "secret: of the old house"],
)
def test_leaves_alone(text):
    assert lexed(text) == []


def test_offsets_are_code_points_and_base_hides_lexed():
    text = f'é🙂 token = "{KEY}"'
    (span,) = secrets.scan(text)
    assert span[0] == "assign" and text[span[1] : span[2]].endswith(KEY)


def test_long_text_is_linear():
    secrets.scan("a=" * 200_000)
    secrets.scan(" a: |\n" * 50_000)
    secrets.scan("a = \"\"\"" * 50_001)
    secrets.scan("pwd " + "a" * 500_000 + "=1")
    secrets.scan("'" * 100_000 + "=" + '"' * 100_000)


def test_operator(spark, docs):
    rows = [(1, f'db_pwd = "{KEY}"'), (2, None), (3, ""), (1, f'db_pwd = "{KEY}"'), (None, "0" * 40)]
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.secret_spans(docs(rows, extra=True)).collect())
    assert got == sorted((str(i), [x[:3] for x in secrets.scan(t or "")]) for i, t in rows)
    assert secrets.secret_spans(docs([])).count() == 0
