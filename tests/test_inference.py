import json

import pandas as pd


def test_scan_and_verify_with_model(spark):
    # analysts are defined here so they are shipped to the workers by value
    def scanner_model(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["prompt"].str.contains("BOOM").any():
            raise RuntimeError("model unavailable")
        replies = []
        for p in pdf["prompt"]:
            if 'token = "' in p:
                replies.append('Sure!\n```json\n[{"line": 1, "severity": "High", "code": "token",'
                               ' "source": ""}]\n```')
            else:
                replies.append("No vulnerabilities found.")
        return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok", "raw": replies})


    def verifier_model(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = [json.dumps([{"line": 1, "verdict": "refuted", "confidence": "High",
                            "verification_reason": "test key"}]) for _ in pdf["prompt"]]
        return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok", "raw": raw})

    from quarry.operators import targets as TG
    from quarry.operators.filters import kept_files
    from quarry.operators.inference import (run_scanner, run_verifier, scan_requests,
                                            verify_requests)
    from quarry.operators.overlay import pending_verifications, verify_eligible
    from quarry.plans import triage as TR
    from quarry.sources.corpus import corpus_from_table
    rows = [(1, "src/a.py", 'token = "abc"\n'), (2, "src/b.py", "print(1)\n"),
            (3, "boom/c.yml", "BOOM\n")]
    corpus = corpus_from_table(spark.createDataFrame(rows, "id bigint, p string, t string"),
                               "p", "t", doc_id="id")
    kept = kept_files(corpus)
    ei, ni = TG.registry_maps(["B2", "B5"])
    catalog = TG.prompt_catalog(spark)
    keyed = TG.with_scan_keys(TG.scan_targets(TG.fan_out(kept, ei, ni)), catalog)
    pending = TG.pending_scans(keyed, None)
    store = run_scanner(scan_requests(pending, corpus, catalog), scanner_model, partitions=3)
    got = {(r["scanner"], r["file"]): (r["status"], r["result"]) for r in store.collect()}
    assert got[("B5", "boom/c.yml")][0] == "error"
    status, res = got[("B2", "src/a.py")]
    assert status == "ok" and json.loads(res)[0]["tags"] == ["unsubstantiated"]
    assert json.loads(got[("B2", "src/b.py")][1]) == []
    # verification of the one file with findings
    rn = TR.normalised_results(store, "v" * 16)
    el = verify_eligible(rn, corpus)
    assert el.count() == 1
    pend = pending_verifications(el, None)
    verdicts = run_verifier(verify_requests(pend, corpus), verifier_model)
    from quarry.operators.overlay import verdict_lines_from_replies
    b = TR.bucketed(rn, verdict_lines_from_replies(verdicts), None)
    assert [r["status"] for r in b.collect()] == ["refuted"]
    # the same verdicts are now cached: nothing left to verify
    assert pending_verifications(el, verdicts).count() == 0
    # the store makes every ok pair reusable; the failed one is retried
    assert {r["path"] for r in TG.pending_scans(keyed, store).collect()} == {"boom/c.yml"}
