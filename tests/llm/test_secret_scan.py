import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from feescope.llm import secret_scan

HIT = "q7Lw9zRt2Xb4Vn8K"  # stands for a secret


def literals(text):
    return {text[a:b] for a, b, _, _ in secret_scan.found_literals(text)}


def brute_base(text):
    """One scan from the left per kind, a character at a time."""
    text = text or ""
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)

    def assign(i):
        name = next((n for n in names if fold(text[i : i + len(n)]) == n), None)
        if not name:
            return None
        j = i + len(name)
        for quote in ([1, 0] if text[j : j + 1] in ("'", '"') and text[j : j + 1] else [0]):
            k = j + quote
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] not in (":", "="):
                continue
            k += 1
            while text[k : k + 1] == " ":
                k += 1
            k += text[k : k + 1] in ("'", '"') and bool(text[k : k + 1])
            m = k
            while m < len(text) and text[m] in value:
                m += 1
            if m > k:
                return m, m - k >= 8
        return None

    def run(i, head, chars, least):
        if text[i : i + len(head)] != head:
            return None
        j = i + len(head)
        while j < len(text) and text[j] in chars:
            j += 1
        return (j, j - i >= least) if j > i + len(head) else None

    kinds = [
        ("assign", assign),
        ("access", lambda i: run(i, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16)),
        ("hex", lambda i: run(i, "", set("0123456789abcdef"), 32)),
    ]
    spans = []
    for order, (kind, at) in enumerate(kinds):
        i = 0
        while i < len(text):
            hit = at(i)
            if hit is None:
                i += 1
                continue
            if hit[1]:
                spans.append((i, order, f"{kind}:{i}:{hit[0]}"))
            i = hit[0]
    spans.sort()
    return spans


pieces = st.sampled_from(
    ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef12", "x", "AKIA", "ABCDEFGH1234", "K", "ſecret",
     "0123456789abcdef" * 2, "f", "é", "\n", "=token=", "+/._-"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=14))
def test_base_spans_against_a_plain_scan(parts):
    text = "".join(parts)
    assert [(a, k) for a, k, _ in secret_scan.base_spans(text)] == [(a, k) for a, k, _ in brute_base(text)]
    assert secret_scan._listed(secret_scan.base_spans(text)) == ",".join(s for _, _, s in brute_base(text))


@pytest.mark.parametrize(
    "text",
    [
        f'db_password = "{HIT}"',
        f"const dbPassword: string = '{HIT}';",
        f'{{"clientSecret":\n  "{HIT}"}}',
        f"auth_pwd: {HIT}\n",
        f"export SERVICE_PWD={HIT}",
        f'config["pwd"] = "{HIT}"',
        f'ENV["PRIVATE_KEY"] => "{HIT}"',
        f'$cfg = array("db_pwd" => "{HIT}");',
        f'define("DB_PWD", "{HIT}")',
        f'props.put("auth.pwd", "{HIT}");',
        f'client.setPwd("{HIT}")',
        f"run --auth-pwd {HIT} now",
        f"run --auth-pwd={HIT}",
        f"<pwd>{HIT}</pwd>",
        f'<add key="DbPwd" value="{HIT}"/>',
        f"- name: DB_PWD\n  value: {HIT}\n",
        f"Authorization: Bearer {HIT}",
        f"postgres://app:{HIT}@db.example/x",
        f'x = "{HIT}"\ny = x\nmy_pwd = y',
        f'my_pwd = later\nlater = "{HIT}"',
        f'BASE="{HIT}"\nMY_PWD=${{BASE}}',
        f'class K:\n    v = "{HIT}"\nlogin(pwd=K.v)\nk = K.v',
        f"don't = 1\npwd = '{HIT}' # isn't it",
        f'pwd = """{HIT}"""',
        f'signing_key := `{HIT}`',
    ],
)
def test_secret_literals_are_found(text):
    assert literals(text) == {HIT}


def test_joined_constants_are_found_piece_by_piece():
    text = f'a = "{HIT[:5]}"\nb = a + "{HIT[5:9]}"\nthe_pwd = b +\n   "{HIT[9:]}"'
    assert literals(text) == {HIT[:5], HIT[5:9], HIT[9:]}
    assert literals(f"the_pwd = '{HIT[:8]}' '{HIT[8:]}'") == {HIT[:8], HIT[8:]}


def test_the_last_value_before_the_use_counts():
    text = f'x = "{HIT}"\npwd = x\nx = "another0Value9Here"'
    assert literals(text) == {HIT}


@pytest.mark.parametrize(
    "text",
    [
        f'build = "{HIT}"',
        f'password_length = "{HIT}"',
        f'public_key = "{HIT}"',
        'pwd = "changeme"',
        "pwd = os.getenv('DB_PWD_NAME_1')",
        "the key: a long word, and keys: more of them",
        f"if pwd == '{HIT}':",
        "pwd = 'two words and more'",
        "pwd = ${UNKNOWN}",
        'pwd_url = "https://example.org/a1B2c3D4e5"',
        "passage: information about passes and authors",
        "a = b\nb = a\npwd = a",
    ],
)
def test_other_literals_are_left_alone(text):
    assert literals(text) == set()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\"'`\\=:+,;()[]{}<>$\n .-1é", max_size=80), st.integers(0, 5))
def test_any_text_is_lexed(text, at):
    found = secret_scan.found_literals(text[:at] + "pwd" + text[at:])
    assert all(0 <= a < b <= len(text) + 3 for a, b, _, _ in found)


@pytest.mark.parametrize(
    "text",
    ['"' * 10**6, '\\"' * 500_000, "'a " * 300_000, "pwd=" * 250_000, "a-" * 500_000, "${" * 500_000, "(" * 10**6, "x" * 10**6, "token " + " " * 10**6,
     "".join(f"a{i} = a{i - 1} + a{i - 1}\npwd = a{i}\n" for i in range(20_000)), "<pwd>" * 200_000],
)
def test_long_hostile_texts_take_linear_time(text):
    start = time.process_time()
    secret_scan.found_literals("pwd " + text)
    secret_scan.base_spans(text)
    assert time.process_time() - start < 20


def test_query(docs):
    rng = random.Random(1)
    rows = [(1, f'é token = "{"0a" * 20}" and AKIA{"Z9" * 8}'), (2, None), (3, ""), (4, f'k = "{HIT}"\nmy_pwd = k'), (None, "x"), (5, "AKIA123")]
    rows += [(10 + i, " ".join(rng.choice(["token:", "secret", "=", "abcdefgh", "ab" * 16, "AKIA" * 5, '"', "é"]) for _ in range(30))) for i in range(60)]
    rows += [rows[0]] * 3
    found = secret_scan.secret_digests(docs(rows)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        base = brute_base(texts[r.doc_id])
        counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        listed = ",".join(s for _, _, s in base)
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("literal")] == [s for _, _, s in base]
    assert next(r.spans for r in found if r.doc_id == 4) == "literal:5:21"
    assert secret_scan.secret_digests(docs([])).count() == 0


def test_given_documents(spark):
    given_docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in given_docs.collect()}
    found = secret_scan.secret_digests(given_docs).collect()
    pattern = re.compile(r'token = "[0-9a-f]{40}"')
    assert any(pattern.search(t) for t in texts.values())
    for r in found:
        assert r.base_sha256 == hashlib.sha256(",".join(s for _, _, s in brute_base(texts[r.doc_id])).encode()).hexdigest()
        assert r.n_assign >= len(pattern.findall(texts[r.doc_id])) and r.n_literal == 0
