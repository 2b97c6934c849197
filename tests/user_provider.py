"""Ten users behind a cursor; the second page is turned away at first."""

asked = []


def users(cursor, size):
    at = int(cursor or 0)
    asked.append(at)
    if at == size and asked.count(at) == 1:
        return [], cursor, True
    rows = [(f"user{i}", bool(i % 3)) for i in range(at, min(10, at + size))]
    return rows, str(at + size) if at + size < 10 else None, False
