"""Cases in which a query once did less than its whole job."""

import re

from tests.conftest import SF
from tidemark import plans
from tidemark.session import table


def test_splits_hold_exactly_what_shares_nothing_with_the_benchmark(spark):
    sf = SF.replace("0.001", "0.01")

    def windows(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}

    texts = [r.text for r in table(spark, sf, "benchmark").collect()]
    listed, whole = set().union(*map(windows, texts)), set(texts)
    docs = table(spark, sf, "documents").collect()
    leaked = {r.doc_id for r in docs if r.text in whole or windows(r.text) & listed}
    assert leaked
    got = {r.doc_id for r in plans.queries()["f3_split"](spark, sf).collect()}
    assert got == {r.doc_id for r in docs} - leaked
