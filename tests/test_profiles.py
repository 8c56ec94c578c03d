"""Clusters of profiles against a plain comparison with every seed, and the redaction of their members."""

import random

from veilstone.functions.lines import lines
from veilstone.operators import profiles
from veilstone.operators.labelled import social_media
from veilstone.operators.redact import redact

PLATFORMS = {"LINKEDIN": r"(?i)linkedin\.com/in/[A-Za-z0-9_.-]{3,100}", "GITHUB": r"(?i)github\.com/[A-Za-z0-9_.-]{1,39}", "TWITTER": r"(?i)twitter\.com/[A-Za-z0-9_]{1,15}"}
SCHEMA = "doc_id LONG, text STRING"


def related(a, b):
    """a, b: (line, user, platform, beside)."""
    u, v = a[1], b[1]
    if u and v:
        if u == v or profiles.bare(u) == profiles.bare(v) or profiles.parts(u) & profiles.parts(v):
            return True
        if min(len(u), len(v)) >= 4 and (u in v or v in u):
            return True
    return b[2] in a[3] or a[2] in b[3]


def brute(rows, reach):
    """Each seed in turn takes all later ones that are near it, related to it, and free."""
    cluster = {}
    for i, a in enumerate(rows):
        if i not in cluster:
            cluster[i] = i
            for j in range(i + 1, len(rows)):
                if j not in cluster and rows[j][0] - a[0] <= reach and related(a, rows[j]):
                    cluster[j] = i
    seeds = sorted(set(cluster.values()))
    return [seeds.index(cluster[i]) for i in range(len(rows))]


def test_seeds_as_by_comparison_with_all(spark):
    rng = random.Random(11)
    names = ["annlee", "ann.lee", "ann_lee7", "bob", "bobby", "theannleeshop", "lee", "x1", "carla-m", "carla99", "m"]
    docs = []
    for d in range(6):
        text = []
        for _ in range(30):
            kind = rng.choice(["linkedin.com/in/", "github.com/", "twitter.com/"])
            text.append(rng.choice(["", "", "plain words", f"see {kind}{rng.choice(names)}", f"{kind}{rng.choice(names)} also on github ", f"{kind}{rng.choice(names)} {kind}{rng.choice(names)}"]))
        docs.append((d, "\n".join(text)))
    found = social_media(lines(spark.createDataFrame(docs, SCHEMA)), PLATFORMS)
    got = profiles.seeded(found, list(PLATFORMS)).collect()
    for d, _ in docs:
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: (r.line_number, r.start))
        rows = [(r.line_number, r.text.rstrip("/").rsplit("/", 1)[1].lower(), r.type.lower(), f"{r.before[-50:]} {r.after[:50]}".lower()) for r in mine]
        assert [r.cluster for r in mine] == brute(rows, profiles.CLUSTER_LINES)


def test_many_profiles_of_one_line():
    seeds, n = profiles.Seeds(), 0
    for i in range(20_000):
        mine = (1, f"user{i:05d}x".replace("user", "q"), "github", "", {"github"})
        if seeds.of(*mine) is None:
            seeds.add(n, *mine)
            n += 1
    assert n > 1000


def test_members_are_redacted(spark):
    text = "me: github.com/annlee\nand linkedin.com/in/ann-lee here\nfar\n"
    docs = spark.createDataFrame([(1, text), (2, "github.com/bob"), (None, None)], SCHEMA)
    found = social_media(lines(docs), PLATFORMS)
    clusters = profiles.profile_clusters(found)
    assert [(r.doc_id, r.line_number, r.last_line, [m.text for m in r.members]) for r in clusters.collect()] == [(1, 1, 2, ["github.com/annlee", "linkedin.com/in/ann-lee"])]
    whole = clusters.selectExpr("doc_id", "doc_key", "line_number", "0 AS start", "0 AS length", "1 AS start_col", "1 AS end_col", "'2 profiles' AS text", "'SOCIAL_MEDIA_CLUSTER' AS type", "members")
    done = {r.doc_id: (r.redacted, r.n_redacted) for r in redact(docs, whole).collect()}
    assert done == {1: ("me: [GITHUB-REDACTED]\nand [LINKEDIN-REDACTED] here\nfar\n", 2), 2: ("github.com/bob", 0), None: ("", 0)}


def test_few_seeds_compared_as_many_looked_up(monkeypatch):
    rng, kinds = random.Random(5), {"github", "twitter"}
    names = ["annlee", "ann.lee", "bob", "bobby", "theannleeshop", "7", "99", "carla-m", "", "m"]
    for _ in range(50):
        rows, line, got = [], 0, []
        for _ in range(40):
            line += rng.choice([0, 0, 1, 3])
            rows.append((line, rng.choice(names), rng.choice(["github", "twitter"]), rng.choice(["", "", "on github"]), kinds))
        for few in (0, 3, 100):
            monkeypatch.setattr(profiles, "FEW", few)
            seeds, n, out = profiles.Seeds(), 0, []
            for mine in rows:
                out.append(seeds.of(*mine))
                if out[-1] is None:
                    seeds.add(n, *mine)
                    n += 1
            got.append(out)
        assert got[0] == got[1] == got[2]


def test_platforms_share_one_pass_over_the_lines(spark):
    rows = spark.createDataFrame([(1, "github.com/anna linkedin.com/in/anna"), (2, "twitter.com/bob")], SCHEMA)
    found = social_media(lines(rows), PLATFORMS)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1 + len(PLATFORMS)  # the text into lines, and a line for each
    assert {(r.doc_id, r.type, r.text) for r in found.collect()} == {(1, "GITHUB", "github.com/anna"), (1, "LINKEDIN", "linkedin.com/in/anna"), (2, "TWITTER", "twitter.com/bob")}
