import random
import string

from strata.llm import secrets


def test_random_tokens_of_one_case_are_found_and_masked(docs):
    rng = random.Random(2)
    alphabets = (string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567")
    tokens = ["".join(rng.choice(a) for _ in range(32)) for a in alphabets for _ in range(20)]
    rows = [(k, f"see {t} there") for k, t in enumerate(tokens)] + [(40, f"seed={tokens[0]}")]
    rows += [(50, "z" * 30 + "1"), (51, "how-to-read-the-next-2000-pages-of-it"), (52, "1234567890" * 2), (53, "internationalization")]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(docs(rows)).collect()}
    assert all(got[k] == "entropy:4:36" for k in range(40)) and got[40] == "entropy:0:37"
    assert all(got[k] == "" for k in range(50, 54))
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(docs(rows)).collect()}
    assert all(masked[k] == "see [SECRET] there" for k in range(40))
