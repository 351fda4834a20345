"""URL verdicts against plain computations: the n-grams, the fit, long urls, and hosts the labels do not hold."""

import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from evalgrain.llm import url_model
from evalgrain.llm.common import table

SMALL = "/root/testdata/sf0.01"


def plain_buckets(host: str, path: str) -> set[int]:
    text = re.sub("[0-9]+", "0", f"^{host}{path}$")
    grams = (text[i:i + n] for n in url_model.SIZES for i in range(max(len(text) - n + 1, 1)))
    return {xxhash.xxh64_intdigest(gram.encode(), 42) % url_model.BUCKETS for gram in grams}


def test_ngrams_of_any_text(spark):
    rows = [("", ""), ("a", ""), ("ab.example.org", "/x/12345.html"), ("straße.example", "/日本/🙂"), ("aaaa", "/aaaa")]
    frame = spark.createDataFrame(rows, "host string, path string")
    got = frame.select("host", "path", url_model.buckets(F.col("host"), F.col("path")).alias("b")).collect()
    for r in got:
        # Spark's pmod takes the signed hash; the bucket count is a power of two, so both agree.
        assert set(r.b) == plain_buckets(r.host, r.path), r.host


def test_fit_is_the_logistic_regression(spark):
    """The gradient of the regularized likelihood vanishes at the fitted weights."""
    labelled = url_model.labelled_urls(spark)
    penalty = 0.05
    weights, intercept = url_model.train(labelled, penalty)
    whole, rows = np.array([*weights, intercept]), labelled.collect()
    gradient = penalty * whole
    for row in rows:
        x = np.zeros(len(whole))
        x[list(plain_buckets(row.host, row.path))] = 1.0
        x[-1] = 1.0
        gradient += (1 / (1 + np.exp(-x @ whole)) - row.label) * x
    assert np.abs(gradient).max() < 1e-3


def test_labels_hold_no_host_of_the_given_pages(spark):
    host = url_model.host_and_path(F.col("url"))[0]
    parts = {part for r in table(spark, SMALL, "pages").select(host.alias("h")).distinct().collect() for part in r.h.split(".")}
    assert not parts & {*url_model.BLOCKED, *url_model.ALLOWED}


def test_long_urls(spark):
    weights = url_model.train(url_model.labelled_urls(spark))
    urls = ["http://news.example.com/" + "abcdefghij" * 30_000, "http://" + "?" * 100_000, "http://" + "/" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    url_model.judge(pages, weights).collect()
    start = time.time()
    got = {r.page_id: r for r in url_model.judge(pages, weights).collect()}
    assert time.time() - start < 10 and len(got[0].path) == 300_001 and got[1].path == ""
