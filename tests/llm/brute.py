"""Plain definitions of the contracts, one document at a time."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def mix_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = (goal - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not more:
            break
        capped |= more
    return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in order}


def contamination(text, items):
    words = WORDS.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item_id, item in items:
        w = WORDS.findall((item or "").translate(LOW))
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("" if item_id is None else str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def rules(text):
    text = text or ""
    w = SPACE_WORDS.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if SPACE_WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def fingerprint(text):
    w = SPACE_WORDS.findall((text or "").translate(LOW))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(rows):
    """{row: root} for (id, fingerprint) rows linked at 3 or fewer bits."""
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)].append(d)
    return [min((d for d in least[top(i)] if d is not None), default=None) for i in range(len(rows))]


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def pii(text):
    out = []
    for k, (name, p) in enumerate(BASE.items()):
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (14 <= len(d) <= 19 and luhn(d)) or name == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    out.sort()
    counts = Counter(x[2].split(":")[0] for x in out)
    return *(counts[n] for n in BASE), hashlib.sha256(",".join(x[2] for x in out).encode()).hexdigest()


def page(rng, word):
    """A page as html and its main text, by construction."""

    def words(lo, hi):
        return [word() for _ in range(rng.randint(lo, hi))]

    def junk():
        name = rng.choice(["ad", "sidebar", "cookie-notice", "newsletter_box", "comments", "share-links", "main related-items"])
        part = rng.choice(["<div class='%s'><p>%s</p></div>" % (name, " ".join(words(1, 30))), "<aside>%s</aside>", "<form><button>%s</button></form>", "<nav><ul><li><a href=/x>%s</a><li><a>y</a></ul></nav>", "<!-- %s -->", "<script>var a='%s </p>'</script>", "<style>%s</style>", "<noscript>%s</noscript>"])
        return part % " ".join(words(1, 12)) if "%s" in part else part

    body, truth = [], []
    for _ in range(rng.randint(1, 8)):
        w = words(1, 40)
        truth.append(" ".join(w))
        shown = [x.replace("&", "&amp;").replace("<", "&lt;") for x in w]
        if len(shown) > 3 and rng.random() < 0.5:
            shown[1] = rng.choice(["<b>%s</b>", "<a href='?a>b'>%s</a>", "<math><mi>%s</mi></math>", "<button>%s</button>", "<span class=side-by-side>%s</span>", "<i title=\"x>y\">%s</i>"]) % shown[1]
        sep = rng.choice([" ", "\n  ", "&nbsp;", "\t"])
        body.append(rng.choice(["<p>%s</p>", "<p>%s", "<div class='social-data'>%s</div>", "<blockquote>%s</blockquote>", "<ul><li>%s</li></ul>", "<h2>%s</h2>", "<table><tr><td>%s</td></tr></table>"]) % sep.join(shown))
        if rng.random() < 0.4:
            body.append(junk())
    head = "<!DOCTYPE html><html><head><title>%s</title></head><body><header><a href=/>Home</a></header>" % word()
    return head + junk() + "<article>" + "".join(body) + "</article>" + junk() + "<footer>&copy; %s</footer></body></html>" % word(), " ".join(truth)


def blocked_hosts(pages, allowed, bad_url):
    """Hosts that links make bad: both walks by plain iteration to the end."""
    link = re.compile(r"""<a href=["']?((?:[a-z]+:)?//[^"'\s>]+)""")
    host = lambda u: re.match(r"(?:.*?:)?//([^/?#]*)", u)[1].lower() if u and "//" in u else ""
    counts, shares = defaultdict(Counter), defaultdict(list)
    for _, url, html in pages:
        shares[host(url)].append(bad_url(url))
        for x in link.findall(re.sub(r"(?s)<!--.*?(-->|$)", " ", html or "")):
            if host(url) and host(x) and host(x) != host(url):
                counts[host(url)][host(x)] += 1
    names = sorted({h for a, to in counts.items() for h in (a, *to)})
    forward = {a: {b: n / sum(to.values()) for b, n in to.items()} for a, to in counts.items()}
    back = defaultdict(dict)
    for a, to in forward.items():
        for b, w in to.items():
            back[b][a] = w
    back = {a: {b: w / sum(to.values()) for b, w in to.items()} for a, to in back.items()}
    bad = {h: sum(shares[h]) / len(shares[h]) if shares[h] else 0.0 for h in names}
    good = {h: float(allowed(h) and bad[h] < 0.5) for h in names}

    def walk(seed, edges):
        total = sum(seed.values())
        if not total:
            return dict.fromkeys(names, 0.0)
        p = {h: seed[h] / total for h in names}
        rank, got = dict(p), {}
        for _ in range(300):
            got = dict.fromkeys(names, 0.0)
            for a, to in edges.items():
                for b, w in to.items():
                    got[b] += 0.85 * rank[a] * w
            rest = 1 - sum(got.values())
            rank = {h: got[h] + rest * p[h] for h in names}
        return got

    trust, distrust = walk(good, forward), walk(bad, back)
    margin = {h: distrust[h] - max(1 / len(names), trust[h]) for h in names}
    return margin
