"""Identifiers whose pattern also fits the number after them."""

import pytest

from lattica.llm import pii

CARD, IBAN = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"


@pytest.mark.parametrize(
    "text,want",
    [
        ("+1 (826) 555-4081 190.137.223.204", [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]), ("+1 826 555 4081 10.0.0.1", [("phone", "+1 826 555 4081"), ("ip", "10.0.0.1")]), ("+49 30 1234567 078-05-1120", [("phone", "+49 30 1234567"), ("ssn", "078-05-1120")]),
        ("+1 826 555 4081 12345 6789", [("phone", "+1 826 555 4081")]), ("+1 (826) 555-4081 +1 (826) 555-4082", [("phone", "+1 (826) 555-4081"), ("phone", "+1 (826) 555-4082")]),
        (f"{CARD} 12/27", [("card", CARD)]), (f"{CARD} 123", [("card", CARD)]), ("4111111111111111 12/27", [("card", "4111111111111111")]), (f"5123 {CARD}", [("card", CARD)]), (f"{CARD} {CARD}", [("card", CARD)] * 2), (f"{IBAN} 2024", [("iban", IBAN)]),
    ],
)
def test_shorter_ends(text, want):
    for around in ("{}", "see {}, thanks"):
        shown = around.format(text)
        got = pii.find(shown)
        assert [(kind, source) for kind, _, _, source, _ in got] == want
        assert all(shown[start:end] == source for _, start, end, source, _ in got)


@pytest.mark.parametrize("text", ["4041894974608796 12/27 isn't a card", "+1234567890123456789", "+1 2 3"])
def test_no_shorter_end_holds(text):
    assert pii.find(text) == []
