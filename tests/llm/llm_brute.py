"""Brute-force versions that several tests use."""

from test_decontaminate import brute
from test_simhash import classes, fingerprint


def simhash_classes(docs):
    return dict(zip([d for d, _ in docs], classes([fingerprint(t) for _, t in docs], [d for d, _ in docs]), strict=True))


def contaminated(docs, items):
    return {d for d, _, hits, _ in brute(docs, items) if hits}
