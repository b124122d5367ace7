"""Disguises in every form, against addresses and numbers that are known; time that grows with the text; and a prefilter that drops nothing."""

import random
import time

import pyarrow as pa
import pytest

from lattica.llm import pii
from lattica.llm.domains import TOP_LEVEL

FORMS = [
    ("jane at example.com", "jane@example.com"), ("jane at example dot it", "jane@example.it"), ("jane at example dot co", "jane@example.co"), ("jane at example dot ai", "jane@example.ai"), ("joe at mail dot house", "joe@mail.house"), ("bob_AT_mail_DOT_com", "bob@mail.com"),
    ("bob AT mail DOT com", "bob@mail.com"), ("jane_at_example_dot_com", "jane@example.com"), ("jane-at-example-dot-com", "jane@example.com"), ("bob  [at]\n example  [dot]\tcom", "bob@example.com"), ("bob dot smith at example dot co dot uk", "bob.smith@example.co.uk"),
    ("bob (dot) smith (at) example (dot) org", "bob.smith@example.org"), ("bob@example dot com", "bob@example.com"), ("bob@example[.]com", "bob@example.com"), ("jean arobase exemple point fr", "jean@exemple.fr"), ("juan arroba ejemplo punto es", "juan@ejemplo.es"), ("a+b%c at example dot net", "a+b%c@example.net"),
    ("five five five dash one two three dash four five six seven", "555-123-4567"), ("plus four nine three zero one two three four five six seven", "+49301234567"), ("six one six one one six one one six one", "6161161161"), ("020 7946 0958", "020 7946 0958"), ("030 1234567", "030 1234567"), ("2001:db8::1", "2001:db8::1"),
]
CLEAN = ["look at example.com", "visit us at example.com/x", "and at the dot of it", "a::b std::vector 12:30:45", "meet at noon. Then go", "arrive at 5. com", "state-of-the-art", "at at at", "one two three", "dot dot dot", "it is at home", "a @ b", "(at) (dot)"]


@pytest.mark.parametrize("shown,value", FORMS)
def test_form(shown, value):
    for around in ("{}", "é: {}, ok", "See {} now"):
        text = around.format(shown)
        assert [(source, found) for _, _, _, source, found in pii.find(text)] == [(shown, value)]
        assert pii.may_hold(pa.array([text])) == [True]


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert pii.find(text) == []


def test_random_disguises():
    draw = random.Random(11)
    at = [" at ", "[at]", " (AT) ", "@", " @ ", "  {at}\n", "<at>", " arroba "]
    dot = [" dot ", "[dot]", " (DOT) ", ".", "{.}", " punto ", "\n(dot) "]
    endings = sorted(TOP_LEVEL)
    for _ in range(2000):
        name, host, end = (f"n{draw.randint(0, 99)}x", draw.choice(["mail", "my-host", "corp7"]), draw.choice(endings))
        shown = name + draw.choice(at) + host + draw.choice(dot) + end
        text = f"Write {shown}; 7 more - thanks"
        assert [(k, v, source) for k, _, _, source, v in pii.find(text)] == [("email", f"{name}@{host}.{end}", shown)], text
        assert pii.may_hold(pa.array([text])) == [True]


def test_every_spoken_digit():
    draw = random.Random(12)
    for word, digit in pii._DIGITS.items():
        rest = [draw.choice(list(pii._DIGITS)) for _ in range(8)]
        text = " ".join(["seven", word, *rest])
        want = "7" + digit + "".join(pii._DIGITS[w] for w in rest)
        assert [v for *_, v in pii.find(text)] == [want] and pii.may_hold(pa.array([text])) == [True]


@pytest.mark.parametrize("unit,before", [("-", "bob @ x.com "), ("a-", "a (at) b "), ("a_", "a at b "), ("four ", ""), ("at ", ""), ("at dot ", ""), ("arroba punto ", ""), (" ", "a at"), ("a.", "a@"), ("1", ""), ("1-", ""), ("[at ", ""), ("a@", ""), ("5 ", "")])
def test_time_grows_with_the_text(unit, before):
    def taken(size):
        text = before + unit * (size // len(unit))
        began = time.process_time()
        pii.find(text)
        return time.process_time() - began

    taken(1000)
    assert taken(400_000) < 5 * taken(100_000) * 2 + 0.5  # four times the text; quadratic time would be sixteen times
