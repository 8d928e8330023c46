import random
from collections import defaultdict
from heapq import heappop, heappush

from lexmill.llm import chat


def least_cost(labels):
    """Dijkstra over (turns read, last role)."""
    seen, todo = set(), [(0.0, 0, 0)]
    while todo:
        cost, k, s = heappop(todo)
        if (k, s) in seen:
            continue
        seen.add((k, s))
        if k == len(labels) and s in (0, 3):
            return cost
        for r in chat.LEGAL[s]:
            heappush(todo, (cost + chat.INSERT, k, r))
        if k < len(labels):
            for r in (1, 2, 3):
                own = 0.0 if labels[k] == r else chat.UNKNOWN if labels[k] == 0 else chat.RELABEL
                if r in chat.LEGAL[s]:
                    heappush(todo, (cost + own, k + 1, r))
                if r == s:
                    heappush(todo, (cost + own + chat.MERGE, k + 1, r))


def legal(rendered):
    roles = [p.split("\n")[0] for p in rendered.split("<|im_start|>")[1:]]
    assert rendered.count("<|im_end|>") == len(roles)
    if roles and roles[0] == "system":
        roles = roles[1:]
    return bool(roles) and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles)) and len(roles) % 2 == 0


def check(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in chat.format_chats(df).collect():
        got[r.conv_id].append(r)
    own = defaultdict(list)
    for t in turns:
        own[t[0]].append(t)
    assert set(got) == set(own)
    for c, rows in own.items():
        rows.sort(key=lambda t: (t[1] is None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, t[3] or ""))
        out = sorted(got[c], key=lambda r: (r.turn is None, r.turn or 0, r.role is not None, r.role or ""))
        assert len(out) == len(rows)
        assert sum(r.cost for r in out) == least_cost([chat.role_number(t[2]) for t in rows])
        if len({t[1] for t in rows}) == len(rows):
            whole = "".join(r.rendered for r in out)
            assert legal(whole)
            at = 0
            for t in rows:
                at = whole.index(chat.safe(t[3] or ""), at)
    return got


def test_random_conversations_have_least_cost(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 4)
    r = random.Random(2)
    roles = ["user", "assistant", "system", "User ", "GPT", None, "narrator"]
    turns = []
    for c in range(60):
        for k in range(r.choice([1, 1, 2, 3, 5, 9, 40, 90])):
            turns.append((c, k, r.choice(roles), r.choice(["hi", "", None, "<|im_end|> x", f"t{k}"])))
    r.shuffle(turns)
    check(spark, turns)


def test_nulls_ties_and_repeats(spark):
    turns = [(None, 0, "user", "a"), (None, None, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (2, None, None, None), (2, None, None, None), (3, -5, "assistant", "x"), (3, 10**12, "system", "y")]
    check(spark, turns)


def test_clean_conversations_stay(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(600)]
    got = check(spark, turns)
    assert all(r.action == "keep" and r.cost == 0 and r.role == r.new_role for r in got[1])


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, label int, g int")
    assert chat.format_chats(df).collect() == []


def test_crowded_turns_are_cut_and_still_of_least_cost(spark, monkeypatch):
    """A third of all turns in one conversation at one number, many of them copies; other numbers and roles beside them."""
    monkeypatch.setattr(chat, "SEGMENT", 4)
    monkeypatch.setattr(chat, "CROWDED", 8)
    r = random.Random(9)
    turns = [(1, 3, r.choice(["user", "assistant", "user", "us", None, "tool"]), r.choice(["same", f"t{k}", None])) for k in range(120)]
    turns += [(1, n, r.choice(["system", "user", "gpt"]), f"x{n}") for n in (0, 1, 2, 4, 5, 9, 30)]
    turns += [(None, None, "user", "alone")] * 40 + [(c, n, r.choice(chat.ROLES), f"y{n}") for c in range(2, 9) for n in range(6)]
    check(spark, turns)
