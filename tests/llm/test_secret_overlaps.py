import random

from groundwork.llm import secrets

SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_spans_beyond_a_base_span_are_kept():
    """A base pattern that covers the first part of a secret does not hide the rest."""
    r, tagger = random.Random(5), secrets.train()
    draw = lambda signs, k: "".join(r.choice(signs) for _ in range(k))
    for _ in range(30):
        for body in (draw("0123456789abcdef", 32) + "." + draw(SIGNS, 16), "AKIA" + draw("ABCDEFGHIJKLMNOP234567", 16) + "/" + draw(SIGNS, 40)):
            text = f"the auth = {body} and more"
            spans = tagger.all_spans([text])[0]
            assert [s for s in spans if s[2] != "crf"] == secrets.base_spans(text) != []
            assert (11, 11 + len(body), "crf") in spans
            assert secrets.redacted(text, spans) == "the auth = [SECRET] and more"


def test_only_spans_within_a_base_span_go():
    tagger = secrets.train()
    for text, _ in secrets.examples(200, seed=3):
        for text in (text, f"token: {text} and deadbeefdeadbeefdead", text.replace(" ", "")):
            base = secrets.base_spans(text)
            want = [s for s in tagger.spans([text])[0] if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
            assert [s for s in tagger.all_spans([text])[0] if s[2] == "crf"] == want
