"""The lexer of secret scans: each syntax, scopes, and what must not be found."""

import random
import re
import time

import pytest

from fathom.llm import secret_scan as S

V = "Zx81kaPq99LmW0t3"
OTHER = "Ab12Cd34Ef56Gh78"


def lexed(text):
    return [text[a:b] for a, b in S.lexed_spans(text)]


FOUND = [
    'let token: string = "{}"', 'api_key: str = "{}"', 'const apiKey: string = "{}"', 'let token: &str = "{}";', 'var dbPassphrase string = "{}"', "privateKey = `{}`",
    'private static final String API_KEY = "{}";', 'const char *secret = "{}";', 'char secret[] = "{}";', 'config["api_secret"] = "{}"', "$password = '{}';", 'password := "{}"', ':password => "{}"',
    'API_KEYS = {{"prod": "{}"}}', 'passwd:\n  value: {}\n', "secret:\n  - {}\n", "secret:\n  - '{}'\n", 'secrets = ["{}", "no"]', '{{"password":{{"value":"{}"}}}}', "db:\n  credentials:\n    prod: {}\n  other: " + OTHER,
    "<password>{}</password>", '<add key="ApiSecret" value="{}"/>', '<property name="password" value="{}"></property>', '<entry key="password">\n  {} </entry>', '<string name="api_key">{}</string>',
    'k="""{}"""; secret=k', 'a = "{}"\nb = a\nsecret = b', 'config = {{k: "{}"}}\nsecret = config.k', 'k = "{}"\nfunction b() {{ secret = k; }}', 'def f():\n    k = "{}"\n    secret = k\n',
    "define('API_KEY', '{}');", 'setenv("DB_PASSWORD", "{}", 1)', '- name: DB_PASSWORD\n  value: "{}"\n- name: USER\n  value: "' + OTHER + '"\n', 'env = [{{"name": "DB_PASSWORD", "value": "{}"}}, {{"name":"x","value":"' + OTHER + '"}}]',
    "export TOKEN={}", "tool --password {} run", "tool --token={}", 'conn = "Server=x;Password={};"', 'Set `token = "{}"` in the file', '# password = "{}"', '/* password = "{}" */', "<!-- token: {} -->", 'k = "{}"\n# k = "other words"\nsecret = k',
]


@pytest.mark.parametrize("text", FOUND)
def test_found(text):
    assert lexed(text.format(V)) == [V]


@pytest.mark.parametrize(
    "text",
    [
        'password = os.getenv("DB_PASSWORD_1a")', "The token of the day: be kind. Note: time = 12", "I don't know the key: it's 'gone'. That's the secret: none", 'token = "(optional)"', f'public_key = "{V}"', "secret_count = 123456789",
        f'# k = "{V}"\nsecret = k', f'def f():\n    k = "{V}"\ndef g():\n    secret = k\n', f'if (t == secret) x = "{V}";', "", "=", "password", "password=", "password:\n", 'password: "unclosed', "}])key:", f'name = "{V}"',
    ],
)
def test_not_found(text):
    assert lexed(text) == []


def test_scopes_keep_constants_apart():
    text = f'function a() {{ var k = "{V}"; }}\nfunction b() {{ var k = "{OTHER}"; secret = k; }}'
    assert lexed(text) == [OTHER]


def test_parts_and_escapes():
    assert lexed('api_secret = "Zx81\\"kaPq99LmW0t3"') == ['Zx81\\"kaPq99LmW0t3']
    for text in ('key_part = "Zx81kaPq" + "99LmW0t3"', 'p = "Zx81kaPq" + "99LmW0t3"\nsecret = p', 'secret = ("Zx81kaPq"\n  "99LmW0t3")', 'password = "Zx81kaPq" . "99LmW0t3"', 'a = "Zx81kaPq"\nsecret = a + "99LmW0t3"'):
        assert lexed(text) == ["Zx81kaPq", "99LmW0t3"], text


# --- against a plain reading of lines


def plain_lines(text):
    """`name = "literal"` and `name = other name` lines read one by one, with one scope."""
    known, found = {}, set()
    at = 0
    for line in text.split("\n"):
        m = re.fullmatch(r'([a-z_]+) = (?:"([^"]*)"|([a-z_]+))', line)
        if m:
            span = (at + m.start(2), at + m.end(2)) if m[2] is not None else known.get(m[3], (at + m.start(3), at + m.end(3)))
            known[m[1]] = span
            value = text[span[0] : span[1]]
            if (named := S.name_score(m[1])) and named + S.literal_score(value) >= S.THRESHOLD:
                found.add(span)
        at += len(line) + 1
    return sorted(found)


def test_chains_equal_a_plain_reading():
    rng = random.Random(1)
    names = ["k", "alias", "secret", "api_key", "password", "note", "public_key", "token_count"]
    for _ in range(400):
        lines = [f"{rng.choice(names)} = " + (f'"{rng.choice([V, OTHER, "plain words", "", "short1A"])}"' if rng.random() < 0.5 else rng.choice(names)) for _ in range(rng.randrange(1, 12))]
        text = "\n".join(lines)
        assert S.lexed_spans(text) == plain_lines(text), text


def test_any_input_ends_soon():
    rng = random.Random(2)
    signs = ["key", "=", ":", "'", '"', '"""', "`", "{", "}", "[", "]", "(", ")", "\n", "  ", "- ", "#", "//", "/*", "*/", "<!--", "-->", "<", "</key>", "<key>", "name", "value", V, "+", "\\", "def f():", "é", "--token "]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        assert all(0 <= a < b <= len(text) for a, b in S.lexed_spans(text))
    for part in ("{", "<a ", "key='", "/*", "a:{", "(", '"', "key=a+", "\n- ", "'\\", "<key> "):
        began = time.process_time()
        S.scan("key " + part * 30_000 + " " * 30_000)
        assert time.process_time() - began < 5, part
