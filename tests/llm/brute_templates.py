"""Templates of texts, word by word, for comparison: nothing of the library is used."""

import re

UNITS = {"kg", "m", "km", "g", "h", "s", "may_not"} | set("mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years kb mb gb tb byte bytes bit bits hz khz mhz ghz w kw v a k c f degree degrees percent euro euros dollar dollars cent cents usd eur gbp".split())


def words(text):
    """(value, may be a number, may be a unit, is in title case, stands at a sentence's start)."""
    out, start = [], True
    for raw in text.split():
        core = re.sub(r"^[^\w$€£¥+-]+|[^\w%°]+$", "", raw)
        if any(c.isalnum() for c in core):
            low = core.lower()
            m = re.fullmatch(r"[-+]?([$€£¥]?)(\d[\d.,:/]*)(%|[a-zµ°]{1,3})?", low)
            if m:
                out.append((m[2].rstrip(".,:/"), True, False, False, start))
                if m[1] or m[3]:
                    out.append((m[1] or m[3], False, True, False, False))
            else:
                out.append((low, False, low in UNITS, len(core) > 1 and core.istitle(), start))
        start = raw.rstrip("\"')]»”’").endswith((".", "!", "?", ":", ";"))
    return out


def read(text, how):
    """(code, value, slot) of each word; how: plain, inner or all."""
    out, after_number = [], False
    for value, number, unit, title, start in words(text):
        if how != "plain" and number:
            out.append(("<number>", value, 1))
        elif how != "plain" and unit and after_number:
            out.append(("<unit>", value, 1))
        elif how != "plain" and title and not unit and (how == "all" or not start):
            out.append(("<name>", value, 2))
        else:
            out.append((value, value, 0))
        after_number = number
    return out


def best_set(shifts):
    """Most windows of shifts that agree with one another, by trying all sets of shifts."""
    fine = []
    for _, hits in shifts:
        pairs = {(s, a, b) for _, ps in hits for s, a, b in ps if s}
        fine.append((pairs, {at for at, _ in hits}))

    def agree(pairs):
        to, back = {}, {}
        return all(to.setdefault(a, b) == b for _, a, b in pairs) and all(back.setdefault(b, a) == a for s, a, b in pairs if s == 2)

    best = 0

    def grow(i, pairs, found):
        nonlocal best
        best = max(best, len(found))
        for j in range(i, len(fine)):
            if agree(pairs | fine[j][0]):
                grow(j + 1, pairs | fine[j][0], found | fine[j][1])

    grow(0, frozenset(), frozenset())
    return best


def held_items(text, items):
    """(share, item) of the items that the text holds, best first."""
    out = []
    for item, other in items:
        shares = []
        for how in ("plain", "inner", "all"):
            a, b = read(other or "", how), read(text or "", how)
            n = min(5, len(a))
            if not n or n < 3 and len(b) != n or len(b) < n:
                continue
            want = {}
            for i in range(len(a) - n + 1):
                if how == "plain" or sum(s == 0 for _, _, s in a[i : i + n]) >= 2:
                    want.setdefault(tuple(c for c, _, _ in a[i : i + n]), i)
            shifts = {}
            for j in range(len(b) - n + 1):
                i = want.get(tuple(c for c, _, _ in b[j : j + n]))
                if i is not None:
                    shifts.setdefault(j - i, []).append((i, [(a[i + k][2], a[i + k][1], b[j + k][1]) for k in range(n)]))
            if want:
                shares.append(best_set(sorted(shifts.items())) / len(want))
        if shares and max(shares) >= 0.8:
            out.append((max(shares), item))
    return sorted(out, key=lambda x: (-x[0], x[1]))
