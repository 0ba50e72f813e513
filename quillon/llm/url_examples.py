"""Labelled URLs that the filter of url_filter learns from: invented hosts, made by a rule from the words below."""

from __future__ import annotations

#: Words that name what a training corpus leaves out, by kind, and the words they come with.
UNWANTED = {
    "gambling": ("casino bets betting poker jackpot slots lottery roulette bingo", "win free online bonus best live club"),
    "adult": ("adult porn xxx sex nude escort webcam hentai camgirls", "x free hot live tube club video"),
    "spam": ("spam seo backlinks clickbait doorway linkfarm", "farm best cheap online free mass"),
    "medicine": ("pills viagra cialis pharmacy steroids", "cheap online best buy free"),
    "advertising": ("ads adserver tracker banner popunder doubleclicks adclick", "track live best media click"),
    "malware": ("phishing malware warez crack keygen torrent", "free best online download"),
    "schemes": ("link traffic", "farm exchange swap"),
}
#: Words of ordinary hosts, which share the second words of the others, so that those alone tell nothing.
WANTED = "news blog garden history science school travel music recipes weather library museum sports health software books university city council farm link traffic exchange swap video tube media track click online live free best cheap hot win mass club buy download bonus x"
ZONES = ("com", "org", "net")


def examples() -> list[tuple[str, str]]:
    """(url, block or allow): each unwanted word with each of its companions, before and after it, in turn under each zone and path; and ordinary hosts of every two ordinary words.

    Words of schemes are ordinary alone, and only their combinations, three times each, are unwanted; the others are unwanted by themselves too.
    """
    blocked = []
    for kind, (words, beside) in UNWANTED.items():
        for word in words.split():
            blocked += [word] * (kind != "schemes")
            for other in beside.split():
                blocked += [f"{word}-{other}", f"{other}-{word}"] * (3 if kind == "schemes" else 1)
    plain = WANTED.split()
    allowed = [a if a == b else f"{a}-{b}" for a in plain for b in plain]
    table = [(host, "block") for host in blocked] + [(host, "allow") for host in allowed if host not in set(blocked)]
    paths = ("en/{}.html", "de/{}", "fr/{}/", "es/{}?page=2", "news/{}", "{}")
    return [(f"https://{('', 'www.', 'blog.', 'm.')[i % 4]}{host}.example.{ZONES[i % 3]}/{paths[i % 6].format(100 + 7 * i % 900)}", label) for i, (host, label) in enumerate(table)]
