import itertools
import random
import re

from pyspark.sql import functions as F

from talkgrid.llm import chat_format as c

TURNS = "conv_id long, turn long, role string, text string"


def least(roles):
    best = {c.START: 0}
    for r in roles:
        step = {}
        for s, cost in best.items():
            for more, t, _, _ in c.options(s, r):
                step[t] = min(step.get(t, 10**9), cost + more)
        best = step
    return min(v + c.end_cost(s) for s, v in best.items())


def legal(names):
    return re.fullmatch(r"(s)?(ua)+|", "".join(n[0] for n in names)) is not None


def roles_in(rendered):
    return re.findall(r"<\|im_start\|>(\w+)\n", rendered)


def test_matrices_give_the_least_cost_of_all_choices():
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            m = c.product(list(roles))
            assert min(m[0][s] + c.end_cost(s) for s in range(4)) == least(roles)


def test_conversations_are_repaired_at_least_cost_whatever_the_blocks(spark):
    rng = random.Random(9)
    names = ["user", "assistant", "system", "human", "GPT ", "tool", None, ""]
    rows = [(i, t, rng.choice(names), rng.choice(["hi", "", None, "x<y"])) for i in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(100, None, "user", "a"), (100, None, "user", "a"), (100, 3, None, None), (100, 3, "user", "b"), (None, 1, "assistant", "z"), (101, -5, "user", "q"), (101, 5000, "assistant", "r")]
    rows += [(200, 1, rng.choice(names), f"t{k % 9}") for k in range(40)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"block": F.lit("b"), "part": F.lit(1), "mark": F.lit("m"), "cost": F.lit(1)})
    for block in (1024, 2, 7):
        got = c.format_chats(df, block).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.conv_id, []).append(r)
        for conv, part in by.items():
            assert sum(r.cost for r in part) == least(own_order(rows, conv)), (block, conv)


def own_order(rows, conv):
    import hashlib

    own = [r for r in rows if r[0] == conv]
    own.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha1((r[3] or "").encode()).hexdigest(), r[2] is not None, r[2] or ""))
    return [c.role_of(r[2]) for r in own]


def test_rendered_pieces_make_a_legal_conversation(spark):
    rng = random.Random(10)
    rows = [(i, t, rng.choice(["user", "assistant", "system", "x"]), f"c{i}t{t}") for i in range(30) for t in range(rng.randrange(1, 12))]
    got = c.format_chats(spark.createDataFrame(rows, TURNS), 4).collect()
    for i in range(30):
        text = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == i), key=lambda r: r.turn))
        assert legal(roles_in(text)), text
        assert text.count("<|im_start|>") == text.count("<|im_end|>") and text.endswith("<|im_end|>\n")
        assert [m for m in re.findall(r"c\d+t\d+", text)] == [r[3] for r in rows if r[0] == i]


def test_empty_table(spark):
    assert c.format_chats(spark.createDataFrame([], TURNS)).count() == 0
