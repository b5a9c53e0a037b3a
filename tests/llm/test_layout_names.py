from demandloom.llm.extract import main_text, main_texts

STORY = "<p>" + "The harbour opened again in spring and the boats went out. " * 6 + "</p>"
TEXT = " ".join(("The harbour opened again in spring and the boats went out. " * 6).split())


def test_layout_and_post_classes_keep_the_article(spark):
    pages = [f'<body><div class="container has-sidebar"><article class="post-12 post hentry tag-news">{STORY}</article><div class="sidebar">Side</div></div></body>',
             f'<body><div class="sidebar-left"><div class="site-footer">Foot</div><article>{STORY}</article></div></body>',
             f'<body><div class="post-12 post hentry tag-news">{STORY}</div><div class="widget-area">Side</div></body>',
             f'<body><div class="sidebar"><p>{STORY}</p><div class="cookie-notice">We use cookies</div></div></body>']
    got = main_texts(spark.createDataFrame([(i, f"http://h{i}.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == dict.fromkeys(range(4), TEXT)


def test_comments_longer_than_the_article_still_go():
    page = f'<body><article>{STORY}</article><section id="comments"><article class="comment">{STORY * 3}</article></section><div class="ad">Buy</div></body>'
    assert main_text(page, None) == TEXT
