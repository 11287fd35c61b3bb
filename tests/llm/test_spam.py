"""Spam pages: the automaton against brute force, and kinds of pages."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm.spam import SuffixAutomaton, spam_pages, spam_share


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=14), st.integers(2, 3))
def test_covered_places(text, times):
    want = [False] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            if sum(text.startswith(text[i:j], k) for k in range(len(text))) >= times:
                want[i:j] = [True] * (j - i)
    assert SuffixAutomaton(list(text)).covered(times) == want


SPAM = [
    "drive belt / Art90986 / lock washer / SKU42539 / frame / limit switch / relay module / SKU45451 / sensor mount",
    "<a href=\"https://seal.example/p/servo.html\">cnc spindle best</a>\n<a href=\"werk.example/out?id=ball+bearing/\">linear guide cheap</a>\n<a href=\"x.example/tag/7\">nozzle 62</a>",
    "液压泵报价 减速机 紧固件 不锈钢法兰 价格不锈钢法兰 报价伺服电机 减速机 紧固件 减速机直销",
    "数控刀具直线导轨直线导轨现货数控刀具数控刀具数控刀具数控刀具直线导轨供应直线导轨数控刀具现货直线导轨定制",
    "Looking for top ball bearing? We have ball bearing, top ball bearing and hex bolt top, because ball bearing top is our ball bearing top. Ball bearing free quote: the free quote ball bearing for your ball bearing, ball bearing best today.",
    "想找减速机价格吗？减速机价格、减速机报价、减速机价格，减速机就选减速机报价。减速机价格，减速机多少钱，专业减速机多少钱，减速机价格欢迎咨询减速机。",
    "tag:hydraulic pump - tag:lock washer - tag:REF54564 - tag:terminal strip - tag:servo motor 24V",
    "#shaft\n#clamp\n#SKU67441\n#bushingIP65\n#fan_hood\n#relay",
    "TOOL HOLDER, tool holder, t.o.o.l.h.o.l.d.e.r, tool holder cheap, buy tool holder, Tool Holder",
]
TEXT = [
    "When the bom template is mounted, check that it turns freely. How often should the bom template be greased? Once per week, unless the bom template runs hot. Do not lift the bom template by its cable. The warranty of the bom template ends after two years.",
    "据了解，夹具已经磨损，而且货架标签缺失。盘点差异为4079，来料检验正在复核单位换算。请先确认是否车间湿度超过83%，再重新盘点。",
    "2024-04-06 14:51:01 INFO M1617 no rule for RM-59252\n2024-04-06 23:44:50 WARN M5319 RM-78022 skipped, price_value is null\n2024-04-06 12:19:31 INFO M2193 t_bom_line: 922 rows",
    "pos;item;qty;uom\n00;RM-25466;388;KG\n10;FG-16081;109;M\n20;RM-27343;156;KG\n30;FG-12327;275;KG",
    "FUNCTION reserve_lot_qty(ii_price IN NUMBER) RETURN NUMBER IS\n    v_x NUMBER := 7;\nBEGIN\n    v_x := v_x + 1;\n    v_x := v_x + 1;\n    RETURN v_x;\nEND reserve_lot_qty;",
    "the injection machine down again, a bent pin, pls check",
    "Parts needed:\n- 15 x pump impeller SA-27343\n- 19 x cable gland FG-53621\n- 2 x hex bolt RM-1\n- 3 x hex bolt RM-2\n- 4 x hex bolt RM-3",
    "Home | Products | Contact\nImprint | About us | Career | Downloads | Imprint\nThe supplier repeated the deviation on the piston, because the winding station was being serviced.",
    "The warehouse took over the request for a second source. Nobody had booked the receipt before Monday.\nSee also\nservo motor: www.werk.example/out?id=erp",
    "RE: PO469234 still open", "ok", ".", "数",
]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert spam_share(text) > 0.5


@pytest.mark.parametrize("text", TEXT)
def test_text(text):
    assert spam_share(text) <= 0.5


def test_pages(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "   \n", 1.0), (4, SPAM[0], None), (4, SPAM[0], None), (None, SPAM[1], 0.0), (5, TEXT[0], 0.0), (6, TEXT[0] + "\n" + SPAM[3] * 40, 0.0), (7, "gear " * 30_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spam_share double")
    got = sorted(str(r["doc_id"]) for r in spam_pages(df, doc_id="doc_id", text="text").collect())
    assert got[:4] == ["4", "4", "6", "7"] and got[4:] == ["None"]
    assert spam_pages(df.limit(0), doc_id="doc_id", text="text").count() == 0


def test_half_is_not_more_than_half(spark):
    assert spam_share(TEXT[0] + "\n" + SPAM[0]) < 0.5 < spam_share(TEXT[5] + "\n" + SPAM[0])


ACROSS = [
    "Buy a cheap servo motor here. Our servo motor price is best. Find servo motor quote today. The best servo motor price. Cheap servo motor quote here. Buy servo motor today.",
    "专业减速机厂家供应。减速机报价欢迎咨询。减速机厂家直销优惠。优质减速机报价优惠。专业减速机直销供应。减速机厂家欢迎咨询。",
]


@pytest.mark.parametrize("text", ACROSS)
def test_repetition_across_sentences_counts(text):
    assert spam_share(text) > 0.5


def test_the_automaton_decides(monkeypatch):
    spam = SPAM[4]
    assert spam_share(spam) > 0.5
    monkeypatch.setattr(SuffixAutomaton, "covered", lambda self, times: [False] * len(self.ends))
    assert spam_share(spam) < 0.5
    monkeypatch.setattr(SuffixAutomaton, "covered", lambda self, times: [True] * len(self.ends))
    odd = "Bitter winter evenings bring heavy snow. Quiet rivers carry broken branches. Small boats cross narrow lakes. Old bridges need fresh paint every spring."
    assert spam_share(odd) > 0.5
    monkeypatch.undo()
    assert spam_share(odd) < 0.5


def test_a_repeated_note_is_no_spam():
    assert spam_share("SA-68637 qty wrong???\n\nSA-68637 qty wrong???") == 0
    phrase = "We checked the spindle and the spindle is fine because the spindle was changed before the shift, as they said to us at the time."
    assert spam_share(phrase + "\n" + TEXT[0]) <= 0.5


def test_nothing_is_spam_without_the_automaton(monkeypatch):
    monkeypatch.setattr(SuffixAutomaton, "covered", lambda self, times: [False] * len(self.ends))
    assert [spam_share(x) for x in SPAM + ACROSS] == [0.0] * len(SPAM + ACROSS)


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=14), st.integers(2, 4))
def test_short_repetitions_do_not_count(text, least):
    want = [False] * len(text)
    for i in range(len(text)):
        for j in range(i + least, len(text) + 1):
            if sum(text.startswith(text[i:j], k) for k in range(len(text))) >= 2:
                want[i:j] = [True] * (j - i)
    assert SuffixAutomaton(list(text), least).covered(2) == want


def test_lists_by_shape():
    assert spam_share("See our page: www.werk.example/a and tell us what you think of it, please.") == 0
    assert spam_share("1. gear 12: www.werk.example/a\n2. relay best - https://b.example/c\n3. shaft (new!) http://d.example/e/f.html") == 1
    assert spam_share("The planner asked for gloves, screws, nuts, washers and oil, because the shelf was empty.") <= 0.5
