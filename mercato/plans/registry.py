"""Registered queries of the price-catalog engine and the SQL they are checked against."""

from mercato.plans import catalog_queries, category_queries, change_queries, crawl_queries, curation_queries, feed_queries, model_queries, name_queries, pick_queries, price_queries, store_queries, stream_queries, text_model_queries

QUERIES: dict = {}
ORACLES: dict = {}
for module in (catalog_queries, price_queries, change_queries, curation_queries, name_queries, feed_queries, model_queries, stream_queries, category_queries, crawl_queries, store_queries, text_model_queries, pick_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
