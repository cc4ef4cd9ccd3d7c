"""Registry, HTML cards, streaming state."""

import pytest
from pyspark.sql import functions as F

from mediafuse.operators import crosswalk
from mediafuse.sources import html
from mediafuse.sources.registry import Registry, Rejected, Source
from mediafuse.streaming.upserts import FoldedState, observations, wait_for

#: Only the markup that the reader looks for, in another order than the page's.
CARD = """<section data-x="js-anime-category-producer"><img {lazy}="https://cdn.myanimelist.net/images/anime/1/{i}.jpg"><i class="js-members">1,234</i><b>js-anime-type-{t}</b>
<u class="js-start_date">20240{m}01</u><a id="n" href="https://myanimelist.net/anime/{i}/x" class="link-title">{title}</a><em class="h3_anime_subtitle">{english}</em><q class="js-score">{s}</q>
<span> {eps} </span><p class="preline">Line &quot;one&quot;<br>two</p></section>"""


def card(i, title="A &amp; B", t=1, english="", s="8.1", m=4, eps="12 eps", lazy="src"):
    return CARD.format(i=i, title=title, t=t, english=english, s=s, m=m, eps=eps, lazy=lazy)


def test_season_cards_by_section(spark):
    page = ('<p><a href="https://myanimelist.net/anime/99">before</a></p><div class="anime-header">TV (New)</div>' + card(5, english="Ay") + card(6, "C", s="N/A", m=0, eps="1 ep", lazy="data-src") + card(8, "").replace("></a>", "> </a>")
            + '<div class="anime-header">TV (Continuing)</div>' + card(7, "D", 3, s="1", eps="? eps") + card(5, "again", 3))
    genre = card(0, "E").replace("https://myanimelist.net/anime/0/x", "/x") + '<div class="genres js-genre" id="9"></div>'
    rows = html.season_cards(spark.createDataFrame([(1, page), (2, genre), (3, None), (4, "")], "k long, page string"), "k", "page")
    got = {(r.k, r.id): (r.section, r.title, r.english_title, r.score, r.members, r.episodes, r.start_date, r.type_id, r.cover, r.synopsis) for r in rows.collect()}
    img, told = "https://cdn.myanimelist.net/images/anime/1/{}.jpg", 'Line "one" two'
    assert got == {(1, "5"): ("TV (New)", "A & B", "Ay", 8.1, 1234, 12, "2024-04-01", 1, img.format(5), told), (1, "6"): ("TV (New)", "C", None, None, 1234, 1, None, 1, img.format(6), told),
                   (1, "7"): ("TV (Continuing)", "D", None, 1.0, 1234, None, "2024-04-01", 3, img.format(7), told), (2, "9"): ("", "E", None, 8.1, 1234, 12, "2024-04-01", 1, img.format(0), told)}
    assert html.current_only(rows).count() == 3


def test_registry_validates_replaces_and_isolates(spark):
    reader = lambda o: lambda s, **_: s.createDataFrame([(o, 1), ("other", 2)], "origin string, n int")
    fails = lambda s, **_: 1 / 0
    r = Registry()
    assert r.register("p", [Source("one", "One", readers={"media": reader("one")}), Source("Bad!", "x"), Source("two", "Two", readers={"media": fails})]) == ["origin 'Bad!' is malformed"]
    assert [tuple(x) for x in r.read(spark, "media").collect()] == [("one", 1)] and list(r.failures) == ["two"]
    with pytest.raises(Rejected):
        r.register("q", [Source("one", "Taken")])
    r.register("p", [Source("three", "Three" * 40)])
    assert [s.origin for s in r.sources] == ["three"] and len(r.sources[0].name) == 64
    r.unregister("p")
    assert r.read(spark, "media") is None


def test_index_bundle_decodes(spark):
    rows = spark.createDataFrame([(0, 7), (1, 0), (2, 4), (3, 90), (4, 1)], "row long, delta long")
    assert [r.decoded for r in crosswalk.delta_decode(rows, "row", F.lit(0)).orderBy("row").collect()] == [7, 0, 11, 101, 102]


def test_merge_ids_contradiction_and_ambiguity(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 0), (6, 60)], "mal long, anilist long")
    b = spark.createDataFrame([(1, 11, 0, 0), (2, 20, 5, 0), (3, 30, 5, 7), (5, 60, 0, 9), (None, 1, 2, 3)], "mal long, anilist long, kitsu long, anidb long")
    got = {r.mal: (r.anilist, r.kitsu, r.anidb) for r in crosswalk.merge_ids([a, b]).collect()}
    assert got == {2: (20, None, None), 3: (30, None, 7), 5: (None, None, 9)}
    with pytest.raises(ValueError):
        crosswalk.guarded(a, 100, "index")


def test_stream_state_equals_batch_in_several_files(spark, tmp_path):
    rows = [(i % 7, i, i * 10 if i % 3 else None) for i in range(60)]
    schema = "k long, seq long, v long"
    for folder, part in (("a", rows[::2]), ("b", rows[1::2])):
        for j in range(3):
            spark.createDataFrame(part[j::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))
    stream = observations(spark, schema, [str(tmp_path / "a"), str(tmp_path / "b")], max_files=1)
    seen = []
    state = FoldedState(spark, str(tmp_path / "state"), "k", "seq", ["v"], after=lambda df, n: seen.append(df.count()))
    query = state.start(stream, str(tmp_path / "checkpoint"), availableNow=True)
    assert wait_for(lambda: not query.isActive, 60) and query.exception() is None
    want = {k: max((s, v) for kk, s, v in rows if kk == k and v is not None)[1] for k in range(7)}
    assert {r.k: r.v for r in state.current().collect()} == want and len(seen) > 1 and seen[-1] == 7
    state.fold(spark.createDataFrame([(0, 999, 1)], schema), 100)
    state.fold(spark.createDataFrame([(0, 999, 1)], schema), 100)
    assert {r.k: r.v for r in state.current().collect()}[0] == 1


def test_search_results_and_season_numbers(spark):
    page = spark.createDataFrame([('<a href="/tv/5-x"><a href="/tv/7"><a href="/tv/5"><a href="/movie/1"> /tv/5/season/2 /tv/5/season/10 /tv/5/season/2',)], "p string")
    r = page.select(html.search_results(F.col("p"), "tv").alias("ids"), html.season_numbers(F.col("p")).alias("n")).first()
    assert (r.ids, r.n) == (["5", "7"], [2, 10])
