"""Queries that read whole tables, against brute force on small ones."""

import re

from palimpsest.functions import fixed as X
from palimpsest.plans import registry

TEXTS = ["the plain one", "Thé and the café", "the “curly” The", "naïve éthe theé", "Ünïcode THE end, the", "", None, "ничего the нет", "no loss"]


def orders(spark, folder, n=600):
    spark.createDataFrame([(i, i * 7 % 311) for i in range(1, n)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")


def test_prose_damage_judges_every_document(spark, tmp_path):
    orders(spark, tmp_path)
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    loss = 0
    for text in filter(None, TEXTS):
        new = re.sub(r"(?i)\bthe\b", "PERSON_001", text)
        loss += sum(max(0, len(re.findall(rf"(?i)\b{w}\b", text)) - len(re.findall(rf"(?i)\b{w}\b", new))) for w in X.PROBES)
    out = registry.QUERIES["prose_damage"](spark, str(tmp_path)).first()
    assert out["stopword_loss"] == loss == 7
    assert out["total"] == out["stopword_name_hits"] + out["short_name_hits"] + loss


def test_map_prune_takes_the_map_of_all_orders(spark, tmp_path):
    orders(spark, tmp_path)
    used = {f"clerk#{i * 7 % 311 % 1000}" for i in range(1, 600) if i % 50 == 7}
    kept = [r["key"] for r in registry.QUERIES["map_prune"](spark, str(tmp_path)).collect()]
    assert sorted(kept) == sorted(used)


def test_the_engine_runs_over_every_customer(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(400)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    out = {r["file_ord"]: r["text"] for r in registry.QUERIES["name_scrub_customers"](spark, str(tmp_path)).collect()}
    assert out == {i: "| Reporter | PERSON_{0:03d} |\nthen PERSON_{0:03d} called PERSON_{0:03d}".format(i + 1) for i in range(400)}
    assert len({r["text"] for r in registry.QUERIES["irreversible_scrub"](spark, str(tmp_path)).collect()}) == 400
    assert registry.QUERIES["harvest_xml_customers"](spark, str(tmp_path)).select("value").distinct().count() == 400


def test_scrub_documents_switches_the_technical_passes_on(spark, tmp_path):
    texts = ["host: srv-a1", "see /home/me/x.log end", "git push origin", "a\n-----BEGIN KEY-----\nabc\n-----END KEY-----\nb", "BSN: 123456782"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["scrub_documents"](spark, str(tmp_path)).collect()
    assert {r["file_ord"]: r["hits"] for r in out} == dict.fromkeys(range(5), 1)
