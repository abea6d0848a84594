"""Small lexicons that come along: enough to show each segmenter at work.

Full dictionaries are read with glyphflow.sources.read_lexicon and given to the
builder.  The words here are fixed values from the published examples.
"""

from __future__ import annotations

#: Fixed values.
SEEDS: dict[str, str] = {
    "thai": "ภาษาไทย ง่าย นิดเดียว ไก่ ขัน ตอนเช้า บน ขันน้ำ ฉัน สระผม ที่ สระน้ำ ด้วย น้ำยา",
    "khmer": "សួស្តី ពិភពលោក",
    "german": (
        "Dampf schifffahrts kapitän fähr über Mittel land kanal Strom brücke Feuchte schutz ins gesamt Literatur verwaltungs programm Schreib prozess Inter kulturalität Wissens organisation "
        "Aufgaben planung Eis brecher Zucker ei Glatt eis Sinn findung Donau dampf gesellschafts Rind fleisch etikettierungs überwachungs aufgaben übertragungs gesetz Nahrungs mittel un verträglichkeits diagnose verfahren "
        "Volley volley ball Fuß Beach Basket Hand Spike"
    ),
    "chinese": "人人 自由 一律 平等 理性 良心 兄弟 精神 互相 人民 意志 政府 权力 基础 定期 真正 选举 予以 表现 夏天 像是 小曲 少年 恶作剧 地上 洒满 一种 灿烂 颜色 开始 学习 语言",
    "japanese": "関西 国際 空港 限定 トート バッグ すもも もも も\tp の\tp うち",
    "korean": "한국어 의 형태 해석 을 실시 할 수 있 습니다",
}

#: Variant, kind of relation, standard form.
KVARIANTS: tuple[tuple[str, str, str], ...] = tuple(
    tuple(x.split(":"))
    for x in "澚:wrong!:澳 䀾:sem:䁈 亚:simp:亞 㮺:old:本 刄:=:刃 杤:simp:𣜜 础:simp:礎 应:simp:應 真:=:眞 选:simp:選 举:simp:舉 现:simp:現 恶:simp:惡 剧:simp:劇 满:simp:滿 烂:simp:爛 颜:simp:顏".split()
)

#: Frequent short words by language: what the built-in detector of languages looks at.
FUNCTION_WORDS: dict[str, str] = {
    "eng": "the of and to in is that for it was with as on be at by this from are or have not which you",
    "fra": "le la les de des du et un une en est que qui dans pour par sur pas au avec ne se ce il",
    "deu": "der die das und den von zu mit dem ist im nicht für auf ein eine als auch es an sich des",
    "spa": "el la los las de del y que en un una es por con para se no su al lo como más",
    "ita": "il lo la gli le di del della e che in un una è per con non si da sono come più",
    "por": "o a os as de do da e que em um uma é por com para não se na no mais como",
    "nld": "de het een van en in is dat op te voor met zijn niet aan er door als ook",
    "swe": "och att det i en som på är av för med den till inte om ett har de var",
    "dan": "og at det i en som på er af for med den til ikke om et har de var",
    "nob": "og å det i en som på er av for med den til ikke om et har de var",
    "fin": "ja on ei se että oli joka mutta ovat kuin myös hän tai",
    "pol": "i w na z do się nie to że jest o jak po ale za od",
    "tur": "ve bir bu da de için ile olarak çok daha gibi olan",
    "rus": "и в не на я что он с как это по но они из у к за от так же",
    "ukr": "і в не на що він з як це по але вони із у до за від так й та",
    "bul": "и в не на че той с как това по но те от за да се е са ще",
    "bel": "і ў не на што ён з як гэта па але яны да за ад так бы",
    "mkd": "и во не на што тој со како ова по но тие од за да се е ќе",
    "srp": "и у не на што он са као ово по али они од за да се је су ће",
    "hin": "के का में की है और से को पर नहीं यह था एक हैं",
    "mar": "आणि च्या आहे मध्ये हा ही हे नाही तो ते एक होते",
    "nep": "र को मा छ हो गर्न यो पनि लागि भएको छन् एक",
    "heb": "של את על לא זה הוא אני עם כי גם או היא",
    "yid": "די און אין איז דער צו ניט פון מיט האט א",
    "vie": "và của là có không cho được trong một các với người",
}
