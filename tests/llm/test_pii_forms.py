"""Each form that a generator accepts, in a text that holds nothing else."""

import random
import string
from collections import Counter

import pytest

from tallyspark.llm import pii


@pytest.mark.parametrize(
    "kind, span",
    [("email", x) for x in ("jane [at] example.com", "jane(at)example.com", "jane at example.com", "jane(at)example\tdot\tcom", "jane@example dot com", "jane[at]example[dot]com")]
    + [("ip", x) for x in ("2001:db8::1", "fe80::1", "::1", "fe80::", "2001:db8:0:1::5:6", "fe:ab:cd:de:fa:ce:be:ad")]
    + [("secret", "QwErTyUiOpAsDfGhJkLzXcVbNmQwErTy")],
)
def test_forms_that_stand_alone(kind, span):
    assert (kind, 0, len(span)) in pii.candidates(span)


def test_forms_are_found_and_prose_is_not():
    detector = pii.train()
    spans = lambda text: pii.find(text, detector)[5]
    assert spans("please write to jane [at] example.com today") == "email:16:37"
    assert spans("host 2001:db8::1 is up") == "ip:5:16" and spans("client address fe80::1 then") == "ip:15:22"
    assert spans('api_key = "QwErTyUiOpAsDfGhJkLzXcVbNmQwErTy"') == "secret:11:43"
    assert spans("We look at home. The cat sits at the door.\nThen use std::vector.") == ""


@pytest.fixture(scope="module")
def detector():
    return pii.train()


def test_secrets_of_any_length_and_without_digits(detector):
    rnd = random.Random(17)
    for n in (24, 30, 150, 10_000):
        letters = "".join(rnd.choice(string.ascii_letters + (string.digits if n > 30 else "")) for _ in range(n))
        text = f"we use {letters} there"
        assert pii.find(text, detector)[5] == f"secret:7:{7 + n}"
        assert pii.redact_text(text, f"secret:7:{7 + n}") == "we use <secret> there"
    assert pii.find(f"write to {'x' * 300} at example.com", detector)[5].startswith("email:9:")


def test_web_tokens_go_whole(detector):
    token = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
    text = f"Authorization: Bearer {token} now"
    assert pii.redact_text(text, pii.find(text, detector)[5]) == "Authorization: Bearer <secret> now"


def test_named_passwords_and_numbers(detector):
    spans = lambda text: pii.find(text, detector)[5]
    assert spans("password: hunter2xyz.") == "secret:10:20" and spans("my ssn 078-05-1120 ok") == "id:7:18"
    assert spans("IBAN DE89 3704 0044 0532 0130 00.") == "id:5:32" and spans("the password is required here") == ""


def test_recall_on_planted_forms(detector):
    """Generators and added spans, kind by kind, on made texts that the trees were not fitted on; look-alikes stay."""
    made, total, proposed, caught, wrong = pii.Made(99), Counter(), Counter(), Counter(), 0
    for _ in range(3000):
        text, kind, start, end = made.text()
        base = pii.base_spans(text)
        added = detector.added(text, base)
        whole = lambda spans: any(a <= start and b >= end - 1 for a, b in spans)
        if not kind:
            wrong += bool(added)
            continue
        total[kind] += 1
        proposed[kind] += whole([(a, b) for k, a, b in pii.candidates(text) if k == kind])
        caught[kind] += whole([(a, b) for k, a, b in added if k == kind] + [s for spans in base.values() for s in spans])
    assert min(proposed[k] / total[k] for k in total) > 0.95 and min(caught[k] / total[k] for k in total) > 0.93
    assert len(total) == 6 and wrong < 15
