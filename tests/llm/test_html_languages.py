"""Pages without <article> in languages that the stop words do not cover."""

import pytest

from monsoonway.llm import html_blocks

TEXTS = ["Tämä on pitkä suomenkielinen kappale, jossa kerrotaan teiden kunnosta sateiden jälkeen ja matka-ajoista kaupunkeihin.",
         "Ez egy hosszú magyar bekezdés, amely az utak állapotáról szól az esőzések után, valamint a városokig tartó utazásról."]


@pytest.mark.parametrize("text", TEXTS)
def test_unmarked_prose_in_any_language_stays(text):
    links = "<div>" + " ".join(f"<a href=x>Linkki numero {i}</a>" for i in range(12)) + "</div>"
    page = f"<html><body><nav><a href=x>Valikko</a></nav><div><p>{text}</p></div>{links}<footer>c</footer></body></html>"
    assert html_blocks.extract(page) == text


def test_a_language_of_repeated_rows_is_learned(spark):
    from monsoonway.llm import langid

    rows = [(i, "la maison est grande et la rue est longue", "fr") for i in range(5000)] + [(9000 + i, f"the house number {i} of the road is large", "en") for i in range(50)]
    rows += [(9900, "123 %%", "xx"), (9901, None, "yy"), (9902, "", "zz")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (1, 20, 500):
        drawn = langid.sample_by_language(labelled, most).collect()
        assert {r["lang"] for r in drawn} == {"fr", "en"} and sum(r["lang"] == "fr" for r in drawn) == 1
    assert langid.train(labelled).langs == ["en", "fr"]
