import random
import string

import pytest

from termloom.llm import secrets

ALPHABETS = {"hex": "0123456789abcdef", "digits": string.digits, "letters": string.ascii_lowercase, "mixed": string.ascii_letters + string.digits, "marks": string.ascii_letters + string.digits + "!@#$%^&*"}


def prose(r, n):
    return " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_recall_of_random_values(alphabet):
    r, scan, found, n = random.Random(7), secrets.scanner(), 0, 0
    for size in range(12, 41, 4):
        for _ in range(20):
            value = "".join(r.choices(ALPHABETS[alphabet], k=size))
            text = f'{prose(r, 40)} token = "{value}" {prose(r, 40)}'
            found += any(text[b:e] == value for b, e, *_ in scan(text))
            n += 1
    assert found >= 0.9 * n


def test_values_with_marks_next_line_and_pem():
    scan = secrets.scanner()
    body = "\n".join("".join(random.Random(i).choices(string.ascii_letters + string.digits, k=64)) for i in range(4))
    for text, value in (
        ("password = Xk9#mQ2$vL7!pR4@", "Xk9#mQ2$vL7!pR4@"),
        ("password: 'pX7#kq!Z'", "pX7#kq!Z"),
        ("api_key:\n  q7XhZk20WmP4", "q7XhZk20WmP4"),
        (f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----", body),
    ):
        assert [text[b:e] for b, e, *_ in scan(text)] == [value]
    for text in ("token of the realm", "secret: placeholder", 'password = "username"', "password: required", "token = xxxxxxxxxxxx", "secret: gerechtigkeiten und mehr"):
        assert scan(text) == []
