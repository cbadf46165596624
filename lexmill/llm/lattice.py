"""Words of scripts that put no blanks between them, by a dictionary lattice.

The dictionary is files, given as parameters: the conf `lexmill.dictionary` (a UTF-8 file, one
word a line, the more frequent first; none by default) and the ranked vocabulary of the
tokenizer (`lexmill.tokenizer`), whose entries that are written in one such script count as
words.  To these come the function words below, which sentence and gap rules rest on.

A run of characters is a lattice: an arc for every dictionary word at every position, and an arc
of one unknown letter with its marks.  The cheapest path gives the words; a word costs more the
later it stands in its file, an unknown letter more than any word.
"""

from __future__ import annotations

import base64
import math
import os
import re
from functools import lru_cache

SPACELESS = "฀-໿ༀ-࿿က-႟ក-៿々-〇぀-ヿㇰ-ㇿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
RUN = re.compile(f"[{SPACELESS}]+")
# A letter with the signs that go with it (Thai, Lao, Tibetan, Burmese, Khmer vowels and tones).
_LETTER = re.compile("(?:[เ-ไເ-ໄ])?.[ะ-ฺๅ-๎ະ-ຼ່-໎༘-༙༵-ཱ༹-྄ྍ-ྼါ-ှၖ-ၙ឴-៓゙-゜ー]*", re.S)

# Function words, by script (fixed values of the languages). Openers begin a statement; links
# bind what follows to what stands before; finals can end a statement.
THAI_OPEN = "บริษัท อัตรา จำนวน คู่สัญญา ลูกหนี้ เจ้าหนี้ นายจ้าง ลูกจ้าง ฝ่าย ใคร หาก ถ้า เมื่อ กรณี ในกรณี นอกจาก นอกจากนี้ ทั้งนี้ อย่างไรก็ตาม ดังนั้น การ ความ ห้าม นาย นาง นางสาว ดร คำ ค่า ดอกเบี้ย เอกสาร สัญญา ข้อตกลง โปรด กรุณา เขา เธอ เรา ท่าน มัน ข้าพเจ้า ผู้".split()
THAI_LINK = "ของ และ หรือ ที่ ซึ่ง อัน โดย กับ แก่ แด่ ต่อ ตาม ก่อน หลัง ภายใน ใน จาก ถึง สู่ เพื่อ ให้ ว่า คือ เป็น จะ ต้อง ไม่ ได้ มี ตกลง เว้นแต่ ยกเว้น แต่ กำหนด ระหว่าง รวมทั้ง เช่น ข้อ ด้วย ทั้ง จึง ก็ อนุมัติ ชำระ ส่งคืน บอกเลิก ร้อยละ".split()
THAI_WORD = "เงิน ประกัน บาท วัน เดือน ต่อ จำกัด มหาชน ถึง สิทธิ คัดค้าน สินค้า ใบแจ้งหนี้ กรมธรรม์ ตัวอย่าง แบบแปลน รายงาน ตรวจสอบ ส่งมอบ เก็บรักษา จดทะเบียน แปล ทะเบียน หนังสือ มอบอำนาจ ลายลักษณ์อักษร ทุก แต่ละ ราย คน มูลค่า ราคา ภาษี ชั่วโมง สัปดาห์ ลงนาม แทน นาม เช่า เช่าซื้อ ซื้อ ขาย ว่าจ้าง รับจ้าง จัดหา ค้ำ รับ อนุญาต กู้ ฝาก โอน เอา ถือ หุ้น เหมา ใด จำหน่าย มอบ ธรรมเนียม".split()
THAI_FINAL = "ปี วัน เดือน สัปดาห์ ชั่วโมง บาท สัญญา คัดค้าน ทันที เท่านั้น แล้ว ล่วงหน้า ลายลักษณ์อักษร นี้ นั้น ครับ ค่ะ คะ นะ ไหม เลย ด้วย".split()
THAI_TITLE = "บริษัท นาย นาง นางสาว ดร".split()
# After a closing quote these go on with the sentence.
JAPANESE_PARTICLE = "と は が を に の も で や へ から まで より という との とか など として とき による において".split()
CHINESE_PARTICLE = "的 等 之 及 和 与 與 或 并 並 且 字样 字樣 一词 一詞 一语 一語 条款 條款 二字 为 為 是 时 時 后 後".split()
COMMON = "的确 的士 和平 和解 与会 与其 及时 及其 等待 等级 等候 之后 之前 并非 且慢 为了 是否 时间 后来 はい はず ところ ともに とても もの もし もう もちろん ですから でも では でしょう にほん やはり やめる がくせい のち へや から です ます である でない された する した".split()


@lru_cache(maxsize=4)
def dictionary(vocabulary: str | None, own: str | None) -> tuple[dict[str, float], int]:
    """({word: cost}, length of the longest). Files that are not there are an error, except
    that no path means no file."""
    out: dict[str, float] = {}
    rank = 0
    if own:
        with open(own, encoding="utf-8") as f:
            for line in f:
                word = line.strip()
                if RUN.fullmatch(word):
                    rank += 1
                    out.setdefault(word, 1.0 + math.log(rank + 1) / 8)
    if vocabulary:
        rank = 0
        with open(vocabulary, "rb") as f:
            for line in f:
                try:
                    word = base64.b64decode(line.split()[0]).decode("utf-8").strip()
                except (ValueError, IndexError):
                    continue
                if RUN.fullmatch(word) and _LETTER.match(word).end() <= len(word) and _one_script(word):
                    rank += 1
                    out.setdefault(word, 1.5 + math.log(rank + 1) / 8)
    for words in (THAI_OPEN, THAI_LINK, THAI_WORD, THAI_FINAL, JAPANESE_PARTICLE, CHINESE_PARTICLE, COMMON):
        for w in words:
            out[w] = min(out.get(w, 9.0), 1.2)
    return out, max(map(len, out))


def _one_script(word: str) -> bool:
    """Han or kana alone or in a mixture, or one other script; no mark at the beginning."""
    if "ะ" <= word[0] <= "ฺ" or "ๅ" <= word[0] <= "๎":
        return False
    blocks = {"j" if c >= "　" else ord(c) >> 7 for c in word}
    return len(blocks) == 1


def paths(spark=None) -> tuple[str | None, str | None]:
    """(vocabulary, dictionary) files of a session, for `dictionary`."""
    from lexmill.llm import tokens

    conf = spark.conf.get if spark is not None else lambda k, d: d
    vocabulary = tokens.tokenizer_path(spark) if spark is not None else os.environ.get("LEXMILL_TOKENIZER") or tokens.DEFAULT
    return vocabulary if vocabulary.endswith(".tiktoken") and os.path.exists(vocabulary) else None, conf("lexmill.dictionary", None) or os.environ.get("LEXMILL_DICTIONARY")


UNKNOWN = 4.0


def words(run: str, known: tuple[dict[str, float], int]) -> list[tuple[int, int, bool]]:
    """(start, end, in the dictionary) of the words on the cheapest path of a run; unknown
    letters side by side make one word. Ties go to the path with the longer last word."""
    costs, longest = known
    n = len(run)
    best = [0.0] + [math.inf] * n
    came = [0] * (n + 1)
    sure = [False] * (n + 1)
    for i in range(n):
        at = best[i]
        if at == math.inf:
            continue
        for j in range(i + 1, min(n, i + longest) + 1):
            cost = costs.get(run[i:j])
            if cost is not None and at + cost < best[j]:
                best[j], came[j], sure[j] = at + cost, i, True
        j = _LETTER.match(run, i).end()
        if at + UNKNOWN < best[j]:
            best[j], came[j], sure[j] = at + UNKNOWN, i, False
    out: list[tuple[int, int, bool]] = []
    at = n
    while at:
        start = came[at]
        if not sure[at] and out and not out[-1][2]:
            out[-1] = (start, out[-1][1], False)
        else:
            out.append((start, at, sure[at]))
        at = start
    return out[::-1]
