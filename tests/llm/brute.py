"""Plain versions of pseudonyms, near copies and encoding, one text at a time."""

import calendar
import datetime
import hashlib
import re

import regex

from tendermill.llm import pii


def number(key, *parts):
    return int(hashlib.sha256("/".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def permuted(key, tag, a, b, size_a, size_b):
    for r in range(8):
        if r % 2 == 0:
            a = (a + number(key, tag, r, b)) % size_a
        else:
            b = (b + number(key, tag, r, a)) % size_b
    return a, b


def restored(key, tag, a, b, size_a, size_b):
    for r in reversed(range(8)):
        if r % 2 == 0:
            a = (a - number(key, tag, r, b)) % size_a
        else:
            b = (b - number(key, tag, r, a)) % size_b
    return a, b


def digits(key, tag, text):
    left = len(text) // 2
    a, b = permuted(key, f"{tag}{len(text)}", int(text[:left]), int(text[left:]), 10**left, 10 ** (len(text) - left))
    return f"{a:0{left}d}{b:0{len(text) - left}d}"


def only(text):
    return re.sub("[^0-9]", "", text)


def filled(layout, new):
    new = iter(new)
    return "".join(next(new) if c in "0123456789" else c for c in layout)


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(text)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def card(key, text):
    if luhn(only(text)) % 10:
        return text
    body = digits(key, "card", only(text)[:-1])
    return filled(text, body + str(-luhn(body + "0") % 10))


def iban(key, text):
    plain = text.replace(" ", "")
    country, bban = plain[:2], plain[4:]
    if mod97(bban + plain[:4]) != 1 or len(only(bban)) < 2:
        return text
    new = filled(bban, digits(key, "iban", only(bban)))
    whole = f"{country}{98 - mod97(new + country + '00'):02d}{new}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if " " in text else whole


def phone(key, text):
    if not text.startswith("+"):
        d = only(text)
        n = digits(key, "national", d[1:3] + d[4:10])
        return filled(text, d[0] + n[:2] + d[3] + n[2:])
    found = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    code = found[0] if found else text[:3]
    rest = text[len(code) :]
    if len(only(text)) < 7 or len(only(rest)) < 4:
        return text
    return code + filled(rest, digits(key, "phone", only(rest)))


def ip(key, text):
    p = list(map(int, text.split(".")))
    if max(p) > 255:
        return text
    a, b = permuted(key, "ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 1 << 16, 1 << 16)
    return ".".join(map(str, (a // 256, a % 256, b // 256, b % 256)))


def ssn(key, text):
    area, group, serial = map(int, text.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return text
    a, b = permuted(key, "ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def date(key, text, order):
    parts = dict(zip(order, map(int, re.split("[-./]", text))))
    y, m, d = parts["y"], parts["m"], parts["d"]
    if not 1 <= m <= 12 or not 1 <= d <= calendar.monthrange(y, m)[1] or y < 400:
        return text
    recent = 1900 <= y <= 2099
    first = datetime.date(1900 if recent else max(1, y // 400 * 400), 1, 1)
    sa, sb = (17, 4297) if recent else (189, 773)
    off = (datetime.date(y, m, d) - first).days
    a, b = permuted(key, f"date{first:%Y-%m-%d}", off % sa, off // sa, sa, sb)
    new = first + datetime.timedelta(days=a + sa * b)
    spelt = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return re.search("[-./]", text)[0].join(spelt[c] for c in order)


def email(key, text):
    return "u" + hashlib.sha256(f"{key}/email/{text.lower()}".encode()).hexdigest()[:16] + re.search("@.*$", text)[0]


def secret(key, text):
    digest = hashlib.sha256(f"{key}/secret/{text}".encode()).hexdigest()
    head = re.match(pii.SECRET_HEAD, text)[0]
    tail = head[-1] if head[-1] in "\"'" else ""
    value = text[len(head) : len(text) - len(tail)]
    new = (digest * (1 + len(value) // 64))[: len(value)]
    upper = head == "AKIA" or (value == value.upper() and re.search("[A-Z]", value) and not head.lower().startswith("password"))
    return head + (new.upper() if upper else new) + tail


def pseudonym(key, text):
    whole = lambda p: regex.fullmatch(p, text, regex.A)
    if whole(pii.SECRET):
        return secret(key, text)
    if whole(pii.EMAIL):
        return email(key, text)
    if whole(f"{pii.PHONE}|{pii.NATIONAL}"):
        return phone(key, text)
    if whole(pii.IP):
        return ip(key, text)
    if whole(pii.IBAN):
        return iban(key, text)
    if whole(pii.SSN):
        return ssn(key, text)
    if whole(pii.ISO_DATE):
        return date(key, text, "ymd")
    if whole(pii.DMY_DATE):
        day, month, year = map(int, re.split("[./]", text))
        as_dmy = 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year or 4, month)[1]
        return date(key, text, "dmy" if text[2] == "." or as_dmy else "mdy")
    return card(key, text)


def pseudonymised(key, text):
    return None if text is None else regex.sub(pii.CANDIDATE, lambda m: pseudonym(key, m[0]), text, flags=regex.A)


def shingles(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def near_copies_dropped(rows):
    """Rows ``(doc_id, text, ...)``: one of each group that pairs of 0.8 or more join, and all without an id."""
    known = [r for r in rows if r[0] is not None]
    sets, root = [shingles(r[1]) for r in known], list(range(len(known)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            alike = known[i][0] == known[j][0] or (len(a & b) >= 0.8 * len(a | b) - 1e-9)
            if alike and (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(known):
        g = find(i)
        least[g] = min(least.get(g, r), r, key=lambda x: (x[0], tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x)))
    return [*least.values(), *(r for r in rows if r[0] is None)]
