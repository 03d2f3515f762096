"""Words of a rare domain count in the domain classifier."""

from curbline.llm import mixing


def test_words_that_only_a_rare_domain_holds(frame):
    common = "plain words of all texts here"
    docs = [(i, f"{common} marked" if i < 9 else common, "b" if i < 9 else "a") for i in range(60)]
    texts = frame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = frame([(i, d) for i, _, d in docs], "doc_id long, domain string")
    domains, weights, bias = mixing.fit_domains(texts, labels)
    new = frame([(100, f"{common} marked"), (101, common)], "doc_id long, text string")
    at = domains.index("b")
    p = {r.doc_id: r.posterior[at] for r in mixing.add_posteriors(new, weights, bias).collect()}
    assert p[100] > 1.5 * p[101], p


def test_the_fit_holds_a_few_texts_at_a_time(frame, monkeypatch):
    """Temporary arrays of the driver are bounded by blocks of texts; the weights do not depend on the blocks."""
    texts = frame([(i, f"w{i} w{i % 7} w{i % 5} end") for i in range(60)], "doc_id long, text string")
    labels = frame([(i, str(i % 3)) for i in range(60)], "doc_id long, domain string")
    monkeypatch.setattr(mixing, "EPOCHS", 3)
    whole = mixing.fit_domains(texts, labels)
    plain, sizes = mixing._posterior, []

    def noted(weights, bias, n, row, slot):
        sizes.append(len(row))
        return plain(weights, bias, n, row, slot)

    monkeypatch.setattr(mixing, "_posterior", noted)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 20)
    blocks = mixing.fit_domains(texts, labels)
    assert len(sizes) > 3 and max(sizes) < 40
    assert whole[0] == blocks[0] and (whole[1] == blocks[1]).all() and (whole[2] == blocks[2]).all()
