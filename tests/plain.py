"""Plain one-by-one versions of the order-dependent operators, to compare with."""


def jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a and b else 0.0


def full(record):
    return f"{record[0]} {record[1]}"


def score(ext, gt):
    return max(
        jaccard(ext[0], gt[0]),
        jaccard(ext[0], gt[1]),
        jaccard(ext[1], gt[0]),
        jaccard(ext[1], gt[1]),
        jaccard(full(ext), full(gt)),
    )


def survivors(records, threshold=0.45):
    alive = []
    for order, record in enumerate(records):
        hits = [o for o in alive if jaccard(full(record), full(records[o])) > threshold]
        if not hits:
            alive.append(order)
        elif len(record[1]) > len(records[hits[0]][1]):
            alive.remove(hits[0])
            alive.append(order)
    return alive


def matches(ext, gt, says_yes, match_from=0.30, judge_from=0.10, ids=None):
    """``(ext, gt, similarity, method)``; ``says_yes(e, g)`` is the verdict on two orders."""
    ids = ids or list(range(len(gt)))
    taken, found = set(), []
    for e, record in enumerate(ext):
        free = [g for g in range(len(gt)) if ids[g] not in taken]
        scored = [(score(record, gt[g]), -g) for g in free]
        top, near = max(scored, default=(0.0, 0))
        pick, method = None, "jaccard"
        if top >= match_from:
            pick = -near
        elif top >= judge_from:
            method = "llm"
            pick = next((g for g in free if says_yes(e, g)), None)
        if pick is not None:
            taken.add(ids[pick])
            found.append((e, pick, top, method))
    return found


def chunks(text, max_chars, separator):
    done, current = [], ""
    for paragraph in text.split(separator):
        if len(current) + len(paragraph) >= max_chars and current:
            done.append(current)
            current = ""
        current += paragraph + separator
    return done + ([current] if current else [])
