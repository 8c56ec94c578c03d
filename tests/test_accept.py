"""Numbers accepted in order, against a plain comparison with all that were accepted before."""

import time

from hypothesis import given
from hypothesis import strategies as st

from veilstone.operators.accept import Accepted
from veilstone.plans.scan import scan

SCHEMA = "doc_id LONG, text STRING"


@given(st.lists(st.text("12+", max_size=40)))
def test_rules_out_what_equals_holds_or_lies_in_an_accepted_number(numbers):
    taken, accepted = Accepted(), []
    for n in numbers:
        want = bool(n) and any(n in x or x in n for x in accepted)
        assert taken.rules_out(n) == want
        if not want and n:
            taken.add(n)
            accepted.append(n)


def found(spark, text):
    return [(r.text, r.confidence) for r in scan(spark.createDataFrame([(1, text)], SCHEMA), ["PHONE"]).orderBy("start").collect()]


def test_shapes_come_in_order(spark):
    assert [t for t, _ in found(spark, "phone (212) 736-5000 ext 12, also 212-736-5000 or +1 212 736 5000")] == ["(212) 736-5000"]
    assert [t for t, _ in found(spark, "phone +44 20 7946 0958 or 020 7946 0958 and 212-736-5001")] == ["+44 20 7946 0958", "020 7946 0958", "212-736-5001"]
    # a number inside an identifier takes no one's place
    assert [t for t, _ in found(spark, "call x-212-736-5000-9 or phone 212-736-5000")] == ["212-736-5000"]


def test_many_numbers_of_one_line(spark):
    def seconds(n):
        text = "phone " + " ".join(f"+1 {200 + i // 10_000_000 % 700} {i // 10_000 % 1000:03d} {i % 10_000:04d}" for i in range(20_000_000, 20_000_000 + n))
        docs, began = spark.createDataFrame([(1, text)], SCHEMA), time.time()
        assert scan(docs, ["PHONE"]).count() > 0.9 * n
        return time.time() - began

    seconds(100)
    assert seconds(60_000) < 6 * max(3.0, seconds(15_000))
