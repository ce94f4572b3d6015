"""Media that scripts name, by literal pages."""

from pyspark.sql import functions as F

from sieveworks.sources import dom, scriptmedia

HTML = r"""<script>jwplayer("x").setup({sources: [{file: "https://c.net/a.mp4"}, {'src':'/no.mp4'}, {"url" : 'https://c.net/b.m3u8'}]});
player.src([{src: "https://c.net/v.mp4", type: "video/mp4"}]); new Plyr('#p', {src: 'https://c.net/p.webm'}); window.u = "https://c.net/window/x"; var m = 'https://c.net/long/name.MPD?x'; var n = "https://c.net/not-media";</script>
<script>window.__INITIAL_STATE__ = {"videoUrl":"https:\/\/c.net\/low-480p.mp4","HLS_URL":"/best-1080p.m3u8","file":"/other-1080p.mp4","src":"/x.png"}</script><script>window.pageData = {"url":"/later-2160p.mp4"}</script>
<script type="application/ld+json">{"embedUrl":"https://c.net/e","url":"https://c.net/video-page","videoUrl":"https://c.net/video/1"}</script>"""


def test_media_of_scripts(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "<script>window.__NUXT__={}</script>"), (4, '<script>{"file": "/s.ts", "pad": "' + "x" * 100 + '"}</script>')], "page_id long, html string")
    got = {tuple(r) for r in scriptmedia.script_media(pages, dom.stored(pages), F.lit("https://e.net/")).collect()}
    assert got == {
        (1, "jwplayer_sources", "https://c.net/a.mp4"), (1, "jwplayer_sources", "https://c.net/b.m3u8"), (1, "videojs_src", "https://c.net/v.mp4"), (1, "plyr", "https://c.net/p.webm"),
        (1, "window_var", "https://c.net/window/x"), (1, "var_assign", "https://c.net/long/name.MPD?x"), (1, "ssr_state", "https://e.net/best-1080p.m3u8"), (1, "linked_data", "https://c.net/video/1"),
        (4, "ssr_state", "https://e.net/s.ts"),
    }


def test_media_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, html string")
    assert scriptmedia.script_media(pages, dom.elements(pages), F.lit("")).count() == 0
