"""Results of several calls of an operator can be read side by side, whatever order they are made and read in."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from framelake.llm.ann import nearest_neighbours
from framelake.llm.html_text import extract_main_text
from framelake.llm.jaccard_join import jaccard_components
from framelake.llm.line_dedup import remove_repeated_chunks
from framelake.llm.mixing import mix_sources
from framelake.llm.multi_index import near_duplicate_vectors
from framelake.llm.warc import archive_pages

DOCS, PAGES, VECTORS = "doc_id long, text string, source string", "page_id long, url string, html string", "vec_id long, embedding array<float>"
OPERATORS = {
    "line dedup": (remove_repeated_chunks, DOCS),
    "mixing": (mix_sources, DOCS),
    "warc": (archive_pages, PAGES),
    "jaccard join": (jaccard_components, DOCS),
    "html": (extract_main_text, PAGES),
    "near dedup": (near_duplicate_vectors, VECTORS),
    "neighbours": (nearest_neighbours, VECTORS),
}


def rows(schema, n):
    if schema == DOCS:
        return [(k, f"a b c d e f {k % n}\nx\ny {k % 3}", "ab"[k % 2]) for k in range(2 * n)]
    if schema == PAGES:
        return [(k, f"http://h/{k}", f"<div>Menu</div><p>{k % n}") for k in range(2 * n)]
    return [(20 * k, [float(k % n), 1.0, 2.0]) for k in range(2 * n)]


@pytest.mark.parametrize("name", OPERATORS)
def test_two_live_results_and_two_threads(spark, name):
    operator, schema = OPERATORS[name]
    frames = [spark.createDataFrame(rows(schema, n), schema) for n in (4, 7)]
    read = lambda f: sorted(map(str, f.collect()))
    alone = [read(operator(f)) for f in frames]
    first, second = (operator(f) for f in frames)
    assert [read(second), read(first), read(second)] == [alone[1], alone[0], alone[1]]
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(lambda f: read(operator(f)), frames)) == alone
