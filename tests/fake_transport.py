"""Answers in place of an API, for tests of data sources. Executors import it by name."""


def energy(call: str, lo: str, hi: str) -> list[dict]:
    day = lo or "2024-01-01"
    if call == "dams-active-volume":
        return [{"date": "2024-03-04T00:00:00", "basinName": "a", "damName": n, "activeVolume": v} for n, v in (("x", 1.5), ("y", 2))]
    if call in ("anc-pf-qty", "anc-pfk"):
        field = "amount" if call == "anc-pf-qty" else "price"
        rows = [{"date": f"{day}T0{h}:00:00+03:00", "hour": f"0{h}:00", field: h + 0.5} for h in range(3)]
        return rows[:-1] if field == "price" else rows
    if call == "idm-qty":
        return [{"kontratTuru": "s", "kontratAdi": "PH24010203", "clearingQuantityAsk": 1, "clearingQuantityBid": 2}, {"kontratTuru": "s", "kontratAdi": "Week 3", "clearingQuantityAsk": 9}]
    if call == "idm-volume":
        return [{"kontratTuru": "s", "kontratAdi": "PH24010203", "volume": 7.5}]
    if call == "planned-outages":
        return [{"id": 1, "date": day, "startTime": f"{day}T05:00:00+03:00", "endTime": None, "province": "p"}, {"id": 2, "date": day, "startTime": f"{day}T05:00:00+03:00", "surprise": 1}]
    return [{"date": f"{lo}T00:00:00+03:00", "hour": "00:00", "generation": 1.0, "forecast": "much"}, {"date": f"{hi}T23:00:00+03:00", "hour": "23:00", "generation": 2.0}]


def paged(lo: str, hi: str, page: int, size: int) -> tuple[list[dict], int]:
    """Sixty rows a window; the first request of a page fails once."""
    if page == 1 and not _failed.setdefault((lo, page), False):
        _failed[lo, page] = True
        raise OSError("try again")
    rows = [{"id": i, "window": lo} for i in range(60)]
    return rows[page * size : (page + 1) * size], 60


_failed: dict = {}
