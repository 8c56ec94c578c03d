"""Connected components of shapes that need many rounds."""

import pytest

from veilstone.llm import components


def test_smaller_label_crosses_a_basin_in_few_rounds(spark, monkeypatch):
    rounds, write = [], components.written

    def counted(df, name):
        rounds.append(name)
        assert rounds.count("lower") <= 20
        return write(df, name)

    monkeypatch.setattr(components, "written", counted)
    chain = [(i, i + 1) for i in range(1, 200)] + [(200, 0), (500, 501), (502, 501)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "src LONG, dst LONG")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in (500, 501, 502)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links(spark, seed):
    import random

    rng = random.Random(seed)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)]
    least = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(len(least)):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert {r.node: r.component for r in components.components(spark.createDataFrame(links, "src LONG, dst LONG")).collect()} == least
