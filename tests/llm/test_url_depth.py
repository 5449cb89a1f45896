"""Operator 7 on paths of more than two segments."""

from docloom.llm import op7_url_filter


def verdicts(spark, pages):
    """Verdict and template by url; good is None for pages without a label."""
    p = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(pages)], "page_id bigint, url string")
    known = spark.createDataFrame([(k, good) for k, (_, good) in enumerate(pages) if good is not None], "page_id bigint, good double")
    return {pages[r["page_id"]][0]: (r["verdict"], r["template"]) for r in op7_url_filter.judge(p, known).collect()}


def test_trees(spark):
    """A host for each case, all judged at once."""
    late = [(f"http://late.net/a/b/c/{x}/{k}", good) for x, good in (("spam", 0.0), ("good", 1.0)) for k in range(30)]
    deep = "/".join("abcdefghij" * 3)
    late += [(f"http://late.net/{deep}/{x}/{k}", good) for x, good in (("spam", 0.0), ("good", 1.0)) for k in range(30)]
    words = [a + b for a in "abcde" for b in "vwxyz"]
    summed = [(f"http://sum.net/shop/{x}/{w}", good) for x, good in (("pills", 0.0), ("books", 1.0)) for w in words]
    # four small bad branches: none is beyond chance alone, together they are
    like = [(f"http://like.net/g/{k}", 1.0) for k in range(40)] + [(f"http://like.net/s{s}/{k}", 0.0) for s in range(1, 5) for k in range(2)]
    literal = [(f"http://lit.net/{x}/{k}", float(good)) for x, good in (("a", 0), ("b", 0), ("c", 1), ("d", 1)) for k in range(12)]
    slugs = [(f"http://slug.net/blog/{w}/{x}", good) for w in words for x, good in (("spam", 0.0), ("text", 1.0))]
    # a few bad children among many good ones that are as small
    odd = [(f"http://odd.net/u{k}/p{j}", float(k >= 5)) for k in range(60) for j in range(5)]
    chance = [(f"http://chance.net/p/{k}", float(k % 2)) for k in range(60)]
    long = "http://long.net/" + "a/" * 100_000
    more = [
        ("http://late.net/a/b/c/spam/x/y/z", None), ("http://late.net/a/b/c/other/1", None), ("http://late.net/", None), ("http://n.net/a/b/c/spam/1", None), ("http://sum.net/shop/pills/new", None),
        ("http://like.net/s9/1", None), ("http://like.net/g/x", None), ("http://slug.net/blog/unseen/spam", None), ("http://slug.net/blog/unseen/text", None),
        (long + "spam", 0.0), (long + "text", 1.0), (long, None), ("http://long.net/b", 1.0),
        # a separator sorts before every character of a segment
        *[(f"http://order.net/en{x}", 1.0) for x in ("", "-a", "/x", "/y", "-a/z")], ("http://order.net/en//", None), ("http://order.net//en", 0.0),
    ]
    got = verdicts(spark, [*late, *summed, *like, *literal, *slugs, *odd, *chance, *more])
    right = lambda pages: all(got[u][0] == ("allow" if good else "block") for u, good in pages)
    assert right(late) and got["http://late.net/a/b/c/spam/1"] == got["http://late.net/a/b/c/spam/x/y/z"] == ("block", "/a/b/c/spam/**")
    assert got["http://late.net/a/b/c/other/1"] == ("allow", "/**") and got["http://late.net/"] == got["http://n.net/a/b/c/spam/1"] == ("allow", "/**")
    assert all(got[u] == (("allow", "/shop/books/**") if good else ("block", "/shop/pills/**")) for u, good in summed) and got["http://sum.net/shop/pills/new"] == ("block", "/shop/pills/**")
    assert right(like) and got["http://like.net/s9/1"] == ("block", "/*/**")
    assert {t for u, (v, t) in got.items() if v == "block" and "//lit" in u} == {"/a|…/**"} and {t for u, (v, t) in got.items() if v == "allow" and "//lit" in u} == {"/c|…/**"}
    assert got["http://slug.net/blog/unseen/spam"] == ("block", "/blog/*/spam/**") and got["http://slug.net/blog/unseen/text"] == ("allow", "/blog/*/text/**")
    assert right(odd) and len({got[u] for u, _ in chance}) == 1
    assert sum("//long" in u for u in got) == 4 and sum("//order" in u for u in got) == 7
