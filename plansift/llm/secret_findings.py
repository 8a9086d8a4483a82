"""Labelled findings for training the secret scanner: made by rule, true secrets and what is taken for them."""

from __future__ import annotations

import random
import string

WORDS = "the of and value build page order report total index item default config user data line house river stone green window market story north number list table entry".split()
PATHS_TRUE = ["config/prod.env", "src/settings.py", "deploy/secrets.yml", "app/main.js", ".env", "notes/ops.txt", "src3", "web/archive", "docs7"]
PATHS_FALSE = ["tests/test_api.py", "examples/demo.py", "docs/sample.md", "fixtures/data.json", "package-lock.json", "go.sum", "src3", "web/archive", "docs7"]
KEY_NAMES = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "credential", "private_key"]
HASH_NAMES = ["commit", "sha256", "checksum", "md5", "digest", "etag", "uuid", "revision", "hash", "integrity", "request id", "trace id", "order", "invoice", "serial", "version", "card", "account"]
PLACEHOLDERS = ["your_api_key_here_123", "example-token-000000", "changeme_password1", "xxxxxxxxxxxxxxxx1", "dummy-secret-value-1", "test_token_1234567", "sample_key_abc123def", "placeholder-value-00", "insert_your_token_1", "my-secret-password-1", "abcdef1234567890", "0123456789abcdef", "1234567890123456", "aaaaaaaaaaaaaaaa1", "deadbeefdeadbeef0", "not_a_real_key_999"]
#: Words of passphrases, and what stands after a key's name without being its value.
PHRASE = "correct horse battery staple velvet cactus purple monkey dragon winter summer sunshine falcon copper guitar rocket silver tiger ocean marble thunder pepper shadow castle".split()
REFERENCES = ["${DB_PASSWORD}", "$API_TOKEN", "$(cat", "os.environ", "process.env.SECRET", "getenv()", "<password>", "{{token}}", "{secret}", "[secret]", "[REDACTED]", "********", "***", "xxxxxxxx", "%s", "null", "None", "true", "false", "required", "string", "optional", "undefined", "unknown", "1", "0", "changeme", "your_password"]


def findings(n: int = 3000, seed: int = 3) -> list[tuple[str, str, int]]:
    """(text with one candidate, path, whether it is a secret)."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    letters, hexes, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    words = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))

    def with_digit(make) -> str:
        while True:
            value = make()
            if any(c.isdigit() for c in value):
                return value

    def assigned(names: list[str], value: str) -> str:
        name = rng.choice(names)
        if rng.random() < 0.2:
            name = name.upper()
        return name + rng.choice(["=", " = ", ": ", '="', ' = "', ": '", " is "]) + value + rng.choice(["", '"', "'", ";"])

    def valued(value: str) -> str:
        name, mark = rng.choice(KEY_NAMES), rng.choice(["", '"', "'"])
        return (name.upper() if rng.random() < 0.2 else name) + rng.choice(["=", " = ", ": "]) + mark + value + mark

    out = []
    for k in range(n):
        if k % 2:
            kind = rng.randrange(12)
            if kind == 0:
                body = rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + "234567", 16)
            elif kind == 1:
                body = rng.choice(["ghp_", "gho_", "ghs_"]) + pick(letters, 36)
            elif kind == 2:
                body = rng.choice(["sk-", "sk_live_", "xoxb-", "glpat-", "AIza"]) + pick(letters, rng.randrange(24, 44))
            elif kind in (3, 4):
                body = assigned(KEY_NAMES, with_digit(lambda: pick(hexes, rng.choice([16, 18, 20, 32, 40, 64]))))
            elif kind == 5:
                body = assigned(KEY_NAMES, with_digit(lambda: pick(letters, rng.randrange(12, 48))))
            elif kind == 6:
                body = assigned(KEY_NAMES, with_digit(lambda: pick(b64, rng.randrange(24, 64))) + rng.choice(["", "=", "=="]))
            elif kind == 7:
                body = rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase, 16)
            elif kind == 8:
                body = rng.choice(["ghp_", "gho_", "ghs_", "sk-", "sk_live_", "xoxb-", "glpat-", "AIza"]) + pick(string.ascii_letters, rng.randrange(24, 44))
            elif kind == 9:
                body = valued(pick(rng.choice([string.ascii_letters, string.ascii_lowercase]), rng.randrange(8, 40)))
            elif kind == 10:
                value = rng.choice(["-", "_", ".", " "]).join(rng.choice(PHRASE) for _ in range(rng.randrange(3, 6)))
                body = rng.choice(KEY_NAMES) + rng.choice(["=", " = ", ": "]) + (f'"{value}"' if " " in value or rng.random() < 0.3 else value)
            else:
                value = rng.choice([str.lower, str.capitalize])(rng.choice(PHRASE))[: rng.randrange(2, 8)] + "".join(rng.choice("!$%@#^*?+~") if rng.random() < 0.4 else rng.choice(letters) for _ in range(rng.randrange(1, 12)))
                body = valued(value + rng.choice("0123456789!?#"))
        else:
            kind = rng.randrange(11)
            if kind == 0:
                body = assigned(KEY_NAMES, rng.choice(PLACEHOLDERS))
            elif kind == 1:
                body = assigned(HASH_NAMES, with_digit(lambda: pick(hexes, rng.choice([16, 32, 40, 64]))))
            elif kind == 2:
                body = rng.choice(["", rng.choice(HASH_NAMES) + " "]) + pick(string.digits, rng.randrange(12, 20))
            elif kind == 3:
                body = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
            elif kind == 4:
                body = "_".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 6))) + str(rng.randrange(1, 999))
            elif kind == 5:
                body = "/".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 5))) + f"/{rng.randrange(2000, 2030)}"
            elif kind == 6:
                body = f"{rng.randrange(2000, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}T{rng.randrange(24):02}00"
            elif kind == 7:
                body = with_digit(lambda: pick(hexes, rng.choice([16, 32, 40])))
            elif kind == 8:
                body = valued(rng.choice(REFERENCES))
            elif kind == 9:
                body = valued(rng.choice(WORDS))
            else:
                body = rng.choice(WORDS).capitalize() + rng.choice(WORDS).capitalize() + rng.choice(WORDS).capitalize() + str(rng.randrange(10, 99))
        path = rng.choice((PATHS_TRUE if rng.random() < 0.8 else PATHS_FALSE) if k % 2 else (PATHS_FALSE if rng.random() < 0.6 else PATHS_TRUE))
        out.append((f"{words(rng.randrange(0, 7))} {body} {words(rng.randrange(0, 7))}".strip(), path, k % 2))
    return out
