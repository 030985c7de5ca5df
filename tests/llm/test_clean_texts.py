"""Clean texts of low characters per token pass the quality rules; what only looks like text doesn't."""

import random
import unicodedata

from nightjar.llm import fertility

VIETNAMESE = (
    "Việt Nam là một quốc gia nằm ở phía đông bán đảo Đông Dương, có đường biên giới trên đất liền với Trung Quốc, Lào và Campuchia. "
    "Người dân ở đây sống chủ yếu bằng nghề trồng lúa, đánh cá và buôn bán nhỏ, nhưng những năm gần đây nhiều người trẻ đã chuyển đến thành phố để tìm việc làm.")
YORUBA = (
    "Orílẹ̀-èdè Nàìjíríà jẹ́ orílẹ̀-èdè tó wà ní ìwọ̀ oòrùn Áfíríkà. Àwọn ènìyàn tó ń gbé níbẹ̀ pọ̀ gan-an, wọ́n sì ń sọ èdè púpọ̀ bíi Yorùbá, Haúsá àti Ígbò. "
    "Ọ̀pọ̀lọpọ̀ wọn jẹ́ àgbẹ̀ àti oníṣòwò tí wọ́n ń ṣiṣẹ́ kára láti bójú tó ẹbí wọn ní ojoojúmọ́.")
FIGURES = (
    "On 31.12.2019: 4,812 staff (2018: 4,397; 2017: 4,105), 37 sites, 1,284.6 m in sales, 96.4 m net, 2.31 a share. On 31.12.2018: 1,226.9 m in sales, 84.1 m net, 1.98 a share. "
    "Debt 402.7 m, 58.2 m less than at 30.06.2018.")
CODE = """for (int i = 0; i < n; i++) {
    if (a[i] != b[i]) { return -1; }
    x += y[i] * (z[i] - 1);
    p->q[k++] = (u8)(x & 0xFF);
    while (*s && *s != ';') { s++; }
    m[i][j] = m[i-1][j] + 1 > m[i][j-1] ? m[i-1][j] : m[i][j-1];
}
return (a > b) ? a : b;"""


def verdicts(spark, rows):
    return {r["text"]: r["kept"] for r in fertility.fertility_rules(spark.createDataFrame(rows, "text string, lang string")).collect()}


def test_clean_texts_are_kept(spark):
    rows = [(VIETNAMESE, "vi"), (unicodedata.normalize("NFD", VIETNAMESE), None), (YORUBA, "yo"), (unicodedata.normalize("NFD", YORUBA), None), (FIGURES, "en"), (CODE, "en")]
    assert set(verdicts(spark, rows).values()) == {True}


def test_noise_is_not(spark):
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    strings = lambda alphabet, n: " ".join("".join(draw.choice(alphabet) for _ in range(n)) for _ in range(60))
    rows = [(strings(letters, 8), "en"), (strings(letters + letters.upper(), 8), None), (strings("0123456789abcdef", 12), "en"), (strings(letters + letters.upper() + "0123456789+/", 16), None)]
    rows.append((" ".join(f"{w}{draw.choice(['$$$', '%%%', '&&&', '***'])}" for w in strings(letters[:9], 5).split()), "en"))
    assert set(verdicts(spark, rows).values()) == {False}
