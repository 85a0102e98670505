"""Operators do the whole job: every section of a page, every language, every text of an id."""

import collections

from sparkboard.llm import html_text, language_id, minhash_dedup


def test_html_keeps_short_sections_after_link_lists():
    body = "".join(f"<p>{'Words of an article. ' * 10}{k}</p>" for k in range(20))
    links = "".join(f"<p><a href=/{k}>See also {k}</a></p>" for k in range(4))
    page = f"<body><div>{body}</div>{links}<p>{'A closing section. ' * 16}</p>{links}<p>The end.</p>"
    got = html_text.main_text(page)
    assert got.count("Words of an article.") == 200 and got.count("A closing section.") == 16 and got.endswith(" The end.") and "See also" not in got


def test_html_joins_article_blocks():
    for tag, end in (("<article>", "</article>"), ('<div class="article-body">', "</div>")):
        blocks = [f"{tag}<p>{'word ' * n}part{n}</p>{end}" for n in (5, 90, 3)]
        assert html_text.main_text(f'<body>{blocks[0]}<div class="ad">Buy</div><p>Between</p>{blocks[1]}<aside>{tag}No{end}</aside>{blocks[2]}').split() == [x for n in (5, 90, 3) for x in ["word"] * n + [f"part{n}"]]
    assert html_text.main_text('<body><article>Text</article><article class="comment">Nice</article>') == "Text"
    assert html_text.main_text('<body><article class="comment">Nice</article>') == "Nice"


def test_language_model_knows_every_language(spark):
    names = [f"l{k:03}" for k in range(205)]
    word = lambda k: "".join(chr(0x4E00 + 300 + 40 * k + j) for j in (0, 7, 3))  # noqa: E731 - letters of its own for each language
    rows = [(f"{word(k)} {word(k)}", la, 0.5 + k / 1000) for k, la in enumerate(names)] * 2 + [("123", "none", 0.1)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string, draw double"))
    assert model.languages == names
    few = language_id.train(spark.createDataFrame(rows[:6] * 4 + [("only one", "rare", 0.99)], "text string, lang string, draw double"), per_language=1)
    assert few.languages == [*names[:6], "rare"] and few.predict("only one")[0] == "rare"


def test_near_duplicates_tell_texts_of_one_id_apart(spark):
    words = lambda name, n=120: [f"{name}{k * k % 97}x{k}" for k in range(n)]
    a, b, c = words("a"), words("b"), words("c")
    near = lambda w: " ".join([*w[:-1], "last"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (9, near(b)), (3, near(c)), (5, " ".join(c)), (6, " ".join(a)), (7, " ".join(b)), (5, " ".join(a)), (8, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.class_id) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == {(5, 5): 3, (5, 3): 1, (7, 5): 2, (9, 5): 1, (3, 3): 1, (6, 5): 1, (8, 8): 2}
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {(5, " ".join(a)), (5, " ".join(b)), (3, near(c)), (8, ""), (8, None)}
