import random

from orgcard.operators.picking import pick_contacts

SCHEMA = (
    "site_key string, page_ord int, block_ord int, method_ord int, stage int, chunk_ord int, kind string, "
    "source_class string, always boolean, value string"
)


def random_site(rng):
    """Candidates of a small crawl, and whether each block holds containers or sections."""
    rows, blocks = [], {}
    for page in range(rng.randint(1, 3)):
        for block in range(rng.randint(1, 2)):
            found = [(m, s) for m, s in ((1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (7, 6), (8, 7), (9, 7)) if rng.random() < 0.35]
            if page == 0 and block == 0 and rng.random() < 0.3:
                found.insert(0, (0, 0))
            has_blocks = any(s in (1, 2) for _, s in found) or rng.random() < 0.3
            blocks[page, block] = has_blocks
            for method, stage in found:
                for chunk in range(rng.randint(1, 3) if stage == 1 else 1):
                    for kind in ("email", "phone"):
                        if kind == "email" and method == 4 or rng.random() < 0.5:
                            continue
                        always = method == 9 or (method == 1 and chunk == 0) or (method == 4 and not has_blocks)
                        source = "override" if method in (1, 4, 9) else "fill"
                        value = f"{kind}-{page}-{block}-{method}-{chunk}"
                        rows.append((page, block, method, stage, chunk, kind, source, always, value))
    return rows, blocks


def crawl(rows, blocks):
    """Visit pages one after the other and keep a mutable record."""
    record = {"email": None, "phone": None}

    def both():
        return all(record.values())

    def apply(selected):
        for row in sorted(selected, key=lambda r: r[2]):
            if row[6] == "override" or not record[row[5]]:
                record[row[5]] = row[8]

    for page in sorted({p for p, _ in blocks}):
        if page > 0 and both():
            break
        for block in sorted(b for p, b in blocks if p == page):
            here = [r for r in rows if r[:2] == (page, block)]
            apply([r for r in here if r[3] == 0])
            stopped = False
            chunks = sorted({r[4] for r in here if r[3] == 1} | ({0} if any(r[3] == 1 for r in here) else set()))
            for chunk in chunks:
                apply([r for r in here if r[3] == 1 and r[4] == chunk])
                if both():
                    stopped = True
                    break
            if not stopped:
                apply([r for r in here if r[3] == 2])
                if not (blocks[page, block] and both()):
                    apply([r for r in here if r[3] == 3])
                    apply([r for r in here if r[3] == 4])
            for stage in (5, 6, 7):
                apply([r for r in here if r[3] == stage])
    return record["email"], record["phone"]


def test_set_form_equals_the_crawl(spark):
    rng = random.Random(7)
    sites = {f"s{i}": random_site(rng) for i in range(400)}
    data = [(k, *r) for k, (rows, _) in sites.items() for r in rows]
    picked = {r["site_key"]: (r["email"], r["phone"]) for r in pick_contacts(spark.createDataFrame(data, SCHEMA)).collect()}
    for key, (rows, blocks) in sites.items():
        assert picked.get(key, (None, None)) == crawl(rows, blocks), (key, rows)


def test_first_policy_aggregates_without_a_window(spark, plan):
    rows = [("s", 1, 0, 9, 7, 0, "email", "override", True, "b"), ("s", 0, 0, 5, 4, 0, "email", "fill", False, "a")]
    picked = pick_contacts(spark.createDataFrame(rows, SCHEMA), policy="first")
    assert picked.first()["email"] == "a" and "Window" not in plan(picked)
