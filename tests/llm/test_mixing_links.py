"""Mixing and url filtering on small tables."""

from seston.llm import links, mixing


def words(n):
    return " ".join(["w"] * n)


def test_targets_and_taken(spark):
    rows = [(i, words(10 + i % 7), "a" if i < 20 else "b" if i < 60 else None) for i in range(100)]
    rows += [(200, None, "a"), (201, "", "c"), (5, rows[5][1], "a"), (None, words(4), "b")]
    docs = spark.createDataFrame([(d, t, s, 1.0) for d, t, s in rows], "doc_id long, text string, source string, key double")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    total = 1.5 * sum(size.values())
    assert abs(sum(target.values()) - total) < 1e-6 and target["c"] == 0
    assert all(t <= 2 * size[s] + 1e-9 and abs(taken[s] - t) <= 20 for s, t in target.items())
    # sources that are not at their limit keep their weights: a 5, b 2, c 1, NULL 5
    free = {s: target[s] / w for s, w in (("a", 5), ("b", 2), (None, 5)) if target[s] < 2 * size[s]}
    assert max(free.values()) - min(free.values()) < 1e-6
    again = sorted((r.doc_id or -1, r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((r.doc_id or -1, r.taken) for r in got)
    kept = mixing.mixed_rows(docs)
    assert kept.columns == docs.columns and kept.where("source = 'c'").count() == 1
    assert mixing.mix(docs.limit(0)).collect() == []


def test_rows_keep_columns_of_any_name(spark):
    """Working names in the table; copies, ties at the edge and texts without words."""
    rows = [(i % 30, words(5 + i % 3), "ab"[i % 5 == 0], 1, 2, "c", "l") for i in range(60)] + [(90, None, "a", 1, 2, "c", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix int, epochs int, cut string, left string")
    kept = mixing.mixed_rows(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert {(r._mix, r.epochs, r.cut, r.left) for r in got} == {(1, 2, "c", "l")} and sum(r.doc_id == 90 for r in got) == 1
    size = sum(len((r.text or "").split()) for r in got)
    assert abs(size - sum(r.taken for r in mixing.mix(docs).collect())) <= 2 * 7 * 2 * 2 and len(taken) == 31
    assert mixing.mixed_rows(docs.limit(0)).collect() == []


RULES = [("allow", "com/"), ("block", "bad.com/x/")]


def page(i, url, *to):
    return (i, url, "".join(f'<a href="{x}">t</a>' for x in to), "h")


def test_rules_and_propagation(spark):
    rows = [
        page(1, "http://Bad.com/x/1?q=/y"), page(2, "https://sub.bad.com/x/2#f"), page(3, "http://good.com/a", "//friend.org/1"),
        page(4, "http://friend.org/p"), page(5, "http://liar.org/p", "http://bad.com/x/1", "http://bad.com/x/3"),
        page(6, "http://alone.org/"), (7, None, None, "h"), (8, "no scheme", "<p>", "h"), page(9, "http://bad.com/x/9"),
        page(9, "http://bad.com/x/9"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in links.filter_urls(pages, RULES, threshold=0.3).collect()}
    assert links.filter_urls(pages, RULES).count() == len(rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("bad.com", "/x/1", "bad.com/x/", "block")
    assert got[2].rule == "bad.com/x/" and got[3].rule == "com/" and got[3].verdict == "allow"
    assert got[4].rule is None and got[4].verdict == "allow" and got[4].trust > 0
    assert got[5].verdict == "block" and got[6].verdict == "allow"
    assert (got[7].host, got[7].path, got[8].host) == ("", "", "")
    assert links.filter_urls(pages.limit(0), RULES).collect() == []


def test_rank_against_iteration(spark):
    edges = [("k", "a", "b", 1), ("k", "b", "c", 2), ("k", "b", "a", 1), ("k", "c", "d", 1)]
    nodes = [("k", x, 0.5 if x in "ab" else 0.0) for x in "abcd"]
    ranks = links.propagate(
        spark.createDataFrame(nodes, "kind string, host string, seed double"),
        spark.createDataFrame(edges, "kind string, a string, b string, n long"),
    )
    got = {r.host: r["rank"] for r in ranks.df.collect()}
    r = {x: s for _, x, s in nodes}
    seed = dict(r)
    for _ in range(100):
        new = {x: 0.15 * seed[x] + 0.85 * r["d"] * seed[x] for x in r}
        new["b"] += 0.85 * r["a"]
        new["c"] += 0.85 * r["b"] * 2 / 3
        new["a"] += 0.85 * r["b"] / 3
        new["d"] += 0.85 * r["c"]
        r = new
    assert all(abs(got[x] - r[x]) < 1e-6 for x in r)
