import pytest

PAGES = "url string, final_url string, title string, html string, clean_text string, fetched_at string, site string, key bigint, n int"


@pytest.fixture
def pages(spark):
    """Builds a crawl_cache frame with clashing extra columns from (url, final_url, title, html, clean_text, fetched_at)."""

    def make(rows):
        return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], PAGES)

    return make
