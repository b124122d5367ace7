"""Enough text outweighs what host, suffix and declaration say, however many pages they are counted over."""

import random

import pytest

from lattica.llm import langid
from tests.llm.test_operators import LANGS, docs_of, sentence


@pytest.mark.parametrize("times", [1, 10])
def test_english_page_on_a_large_french_host(spark, times):
    draw = random.Random(3)
    docs = docs_of(spark, [(k, sentence(draw, lang), lang, lang) for k, lang in enumerate(list(LANGS) * 100)])
    pages = [(k, f"http://www.site.fr/{k}", f'<html lang="fr"><p>{sentence(draw, "fr")}</p></html>') for k in range(1000 * times)]
    pages += [(100_000 + k, f"http://www.site{k % 40}.com/{k}", f'<html lang="en"><p>{sentence(draw, "en")}</p></html>') for k in range(2000 * times)]
    pages.append((-1, "http://www.site.fr/about", f'<html lang="fr"><p>{sentence(draw, "en", 200)}</p></html>'))
    pages.append((-2, "http://www.site.fr/none", '<html lang="fr"><p></p></html>'))  # without text the rest decides
    found = langid.language_id(docs, spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    by = {r.page_id: r for r in found.where("page_id < 0").collect()}
    assert by[-1].lang == by[-1].text_lang == "en"
    assert by[-2].lang == "fr" and by[-2].text_lang is None
