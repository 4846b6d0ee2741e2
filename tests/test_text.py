"""Cheap text tests against the patterns they stand for."""

from pagelight.functions import text
from pagelight.operators import checks

SENSORY_BEFORE = (
    r"(?i)\b(click|tap|press)\s+the\s+(red|green|blue|yellow|orange|purple|round|square|triangle|circular|rectangular)\s+\w+"
    r"|\b(on\s+the\s+(left|right|top|bottom))\b|\bthe\s+(round|square|triangle|circular|rectangular)\s+(icon|button|shape|symbol)\b"
    r"|\bsee\s+(the\s+)?(red|blue|green|yellow|orange|colored|colour)\b|\b(above|below)\s+(chart|image|figure|table)\b")
FOREIGN_BEFORE = "[一-鿿]|[Ѐ-ӿ]|[؀-ۿ]|[ऀ-ॿ]|[àáâãäåæçèéêëìíîïðñòóôõöùúûüýþÿ]{3,}"
TEXTS = [
    None, "", " ", "\n", "\u0085\u2003\u3000\u001c", " \ta\n", "a\n", "\n\n", "\u200b", "😀", " 😀 ", "\u00a0", "Click  THE red x", "xclick the red x", "press the Round\nbutton",
    "press the round", "ON the left", "on the lefty", "button on\tthe top.", "the circular symbol", "bathe circular symbol", "see colour", "oversee red", "See the\nblue one",
    "above chart", "Below  Table", "below tables", "_above chart", "éabove chart", "аéclick the red x", "HTTPS://a", "http:// a", "x://y", "http:/x", "汉", "при", "ééé", "éé", "éàü z", "عر", "हि", "ÉÉÉ", "plain",
]


def test_cheap_tests_equal_their_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "content string")
    pairs = {
        "blank": (text.q_blank("content"), f"coalesce({text.q_strip('content')} = '', true)"),
        "sensory": (text.q_like("content", text.SENSORY), text.q_like("content", SENSORY_BEFORE)),
        "foreign": (text.q_foreign("content"), text.q_like("content", FOREIGN_BEFORE)),
        "url": (text.q_url("content"), text.q_like("content", text.URL)),
    }
    for name, (cheap, plain) in pairs.items():
        got = rows.selectExpr("content", f"{cheap} AS cheap", f"{plain} AS plain").collect()
        assert [r.content for r in got if r.cheap != r.plain] == [], name
        assert any(r.cheap for r in got) and not all(r.cheap for r in got)


def test_blank_and_scripts_read_a_text_once():
    assert "regexp_replace" not in text.q_blank("content")
    assert checks.SCRIPT.index("octet_length") < checks.SCRIPT.index("rlike")
