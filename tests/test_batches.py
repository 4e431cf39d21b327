"""What Python holds at once follows neither the rows of an Arrow batch nor the table."""

import pyarrow as pa
import pytest

from moothall.operators import index, search
from moothall.sources import agendas, pages, structure


class Caught:
    """Stands in for pages, and gives the parser's function back."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


@pytest.mark.parametrize("parse", [pages.parse_pages, agendas.page_nodes, structure.page_nodes])
def test_parsers_send_what_they_have(spark, parse):
    html = "<ul>" + "<li><a href='x'>text</a></li>" * 100 + "</ul>"
    many = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["http://h/"] * 500), pa.array([html, None] * 250)], ["page_id", "url", "html"])
    sent = [len(b.column("nodes").flatten()) if "nodes" in b.schema.names else b.num_rows for b in parse(Caught())(iter([many]))]
    assert len(sent) > 1 and max(sent) < 21_000 and sum(sent) >= 250 * 200


@pytest.mark.parametrize("words", [index._spots, search._stems])
def test_words_keep_their_texts(words):
    """Texts of one Arrow batch whose words go to Arrow in several lots."""
    texts = ["one trash " * 400, None, "", "é x"] * 200
    whole = next(words(iter([pa.array(texts)])))
    each = [next(words(iter([pa.array([t], pa.string())])))[0].as_py() for t in texts[:4]]
    assert whole.to_pylist() == each * 200
    assert next(words(iter([pa.array([], pa.string())]))).to_pylist() == []
