from demandloom.llm.secrets import secrets


def test_values_after_an_equals_sign_are_tested_by_themselves(rows):
    key, sig, url = "q7Rz0Lk2vXw9Tn4Bp8Hs3Yd6Mf1Jc5GaEuKo", "mX3+bV9/Qe7Lk2Zt5Rw8Hy1Ns6Pd4Fg0Jc=", "Zk8_pW2-rT6vB1nM9xQ4sL7yH3cD5gJ0fEaUo"
    text = f"SESSION_ID={key} GET /a?sig={sig}&page=2\nAWS_ACCESS_ID={url}\nMAX_CONNECTION_RETRIES=3 plainwordsplainwords=yes"
    got = secrets(rows((1, text), (2, None))).collect()
    spans = {r.doc_id: [(s["kind"], text[s["start"]:s["end"]]) for s in r.spans] for r in got}
    assert spans == {1: [("random", key), ("random", sig), ("random", url)], 2: []}
