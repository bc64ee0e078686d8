"""Generated event logs (seeded) and sequential brute-force answers for them."""

import random


def login_rows(seed=1, n=160, users=12, t0=1_700_000_000):
    """(user_id, ip, event_type, ts, seq): bursts of logins, some out of order by a few seconds."""
    rnd = random.Random(seed)
    rows, t = [], t0
    for seq in range(n):
        t += rnd.choice([0, 0, 1, 1, 2, 7])
        user = rnd.randrange(users)
        kind = "fail" if rnd.random() < (0.8 if user < 3 else 0.15) else "success"
        rows.append((user, f"10.1.{user}.{rnd.randrange(250)}", kind, t - rnd.choice([0, 0, 0, 1, 3]), seq))
    return rows


def order_rows(seed=2, n=60, t0=1_700_000_000, timeout=900):
    """(order_id, event_type, tx_id, ts, seq): paid in time, at the bound, late, never, before the
    create, twice, and pays without a create."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        order, t = 500 + k, t0 + rnd.randrange(5000)
        kind = k % 8
        pays = {0: [30], 1: [rnd.randrange(1, timeout)], 2: [timeout], 3: [timeout + rnd.randrange(1, 500)],
                4: [], 5: [-40], 6: [10, 50], 7: [rnd.randrange(1, timeout)]}[kind]
        if kind != 7:
            rows.append([order, "create", "", t])
        rows += [[order, "pay", f"p{order}-{j}", t + d] for j, d in enumerate(pays)]
    rows.sort(key=lambda r: (r[3] + rnd.randrange(4), r[0]))
    return [(*r, seq) for seq, r in enumerate(rows)]


def receipt_rows(orders, seed=3):
    """(tx_id, pay_channel, ts, seq) for most pays, some beyond 5 s, and some of nobody's."""
    rnd = random.Random(seed)
    rows = [(tx, rnd.choice(["card", "cash"]), ts + rnd.choice([-9, -5, -4, 0, 3, 5, 6, 40]))
            for _, kind, tx, ts, _ in orders if kind == "pay" and rnd.random() < 0.85]
    rows += [(f"lost{k}", "cash", 1_700_000_000 + 100 * k) for k in range(4)]
    return [(*r, seq) for seq, r in enumerate(sorted(rows, key=lambda r: r[2]))]


def lines(rows):
    """CSV lines of rows without their seq."""
    return [",".join(str(x) for x in r[:-1]) for r in rows]


def write_csv(path, rows, newline="\r\n"):
    path.write_bytes(newline.join(lines(rows)).encode())
    return str(path)


def _by_key(rows, key, ts):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return {k: sorted(v, key=lambda r: (r[ts], r[-1])) for k, v in out.items()}


def fail_pairs(rows, within):
    out = []
    for user, events in _by_key(rows, 0, 3).items():
        for a, b in zip(events, events[1:]):
            if a[2] == b[2] == "fail" and b[3] - a[3] < within:
                out.append((user, a[3], b[3]))
    return sorted(out)


def fail_bursts(rows, window, min_fails):
    out = []
    for user, events in _by_key(rows, 0, 3).items():
        runs, run = [], None
        for r in events:
            if r[2] != "fail":
                if run and r[3] <= run[0] + window:
                    run.append("ok")
                run = None
            elif run is None:
                run = [r[3], r[3]]
                runs.append(run)
            elif r[3] <= run[0] + window:
                run.append(r[3])
        for r in runs:
            times = [t for t in r[1:] if t != "ok"]
            if "ok" not in r and len(times) >= min_fails:
                out.append((user, times[0], times[-1], len(times)))
    return sorted(out)


def _creates(rows):
    for order, events in _by_key(rows, 0, 3).items():
        for k, r in enumerate(events):
            if r[1] == "create":
                yield order, r, [x for x in events[:k] if x[1] == "pay"], [x for x in events[k + 1:] if x[1] == "pay"]


def order_pattern(rows, within):
    """{(order, create ts): pay ts or None}"""
    return {(o, c[3]): after[0][3] if after and after[0][3] - c[3] < within else None
            for o, c, _, after in _creates(rows)}


def order_status(rows, timeout):
    return {(o, c[3]): bool(after) and after[0][3] <= c[3] + timeout for o, c, before, after in _creates(rows) if not before}


def order_match(rows, timeout, horizon=None):
    out = {}
    for order, events in _by_key(rows, 0, 3).items():
        c = next((r[3] for r in events if r[1] == "create"), None)
        p = next((r[3] for r in events if r[1] == "pay"), None)
        if horizon is not None and c is not None and p is not None:
            if p > c + horizon:
                p = None
            elif c > p + horizon:
                c = None
        if p is None:
            out[order] = "time out"
        elif c is None:
            out[order] = "already payed but not found create log"
        else:
            out[order] = "payed successfully" if p < c + timeout else "payed but already timeout"
    return out


def tx_pairs(orders, receipts, bound):
    """(pairs, pays without receipt, receipts without pay), each a sorted list."""
    pays = [r for r in orders if r[2]]
    pairs = sorted((p[2], p[0], r[2] - p[3]) for p in pays for r in receipts if r[0] == p[2] and abs(r[2] - p[3]) <= bound)
    met = {x[0] for x in pairs}
    lone_pays = sorted(p[2] for p in pays if not any(r[0] == p[2] and abs(r[2] - p[3]) <= bound for r in receipts))
    lone_receipts = sorted(r[0] for r in receipts if not any(r[0] == p[2] and abs(r[2] - p[3]) <= bound for p in pays))
    assert met.isdisjoint(lone_pays)
    return pairs, lone_pays, lone_receipts
