import pytest

from termloom.llm import pii


@pytest.mark.parametrize("number", ["+33 1 23 45 67 89", "06 12 34 56 78", "+49 30 1234567", "+49 (0)30 123456", "+34 91 123 45 67", "+44 20 7946 0958", "030 1234567", "06.12.34.56.78"])
def test_phones_of_europe(number):
    assert [(k, v) for k, _, _, v, _ in pii.detect(f"call {number}, please")] == [("phone", number)]


def test_plain_host_after_a_spelled_at(docs):
    text = "write jane at example.com now"
    assert [(k, text[a:b], v) for k, a, b, v, _ in pii.detect(text)] == [("email", "jane at example.com", "jane@example.com")]
    found = pii.find(docs((1, text, None), (2, "jane﹫example.com", None), (3, "look at www.example.com on 01.02.2024 or 03-04-2024", None))).collect()
    assert sorted((r.doc_id, r.value) for r in found) == [(1, "jane@example.com"), (2, "jane@example.com")]
