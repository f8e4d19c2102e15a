"""Word lists and weights used by the scoring functions.

All of them are parameters of the functions that use them; these are defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Sentiment keywords, matched as substrings of the lower-cased text.
BULLISH = (
    "buy", "bull", "bullish", "up", "rise", "gain", "profit", "long",
    "rally", "surge", "breakout", "support", "strong", "positive",
)
BEARISH = (
    "sell", "bear", "bearish", "down", "fall", "loss", "short",
    "crash", "drop", "breakdown", "resistance", "weak", "negative",
)

# Hashtags that mark a post as being about the market.
MARKET_TAGS = ("nifty50", "sensex", "intraday", "banknifty")

# English stop words, the default list of Spark's StopWordsRemover.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did
    doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now i'll you'll
    he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
    doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
    how's let's ought that's there's what's when's where's who's why's would
    """.split()
)


@dataclass(frozen=True)
class Lexicon:
    bullish: tuple[str, ...] = BULLISH
    bearish: tuple[str, ...] = BEARISH
    label_cut: float = 0.2


@dataclass(frozen=True)
class EngagementWeights:
    likes: float = 1.0
    retweets: float = 2.0
    replies: float = 1.5
    cap: float = 100_000.0


@dataclass(frozen=True)
class SignalWeights:
    sentiment: float = 0.5
    engagement: float = 0.3
    custom: float = 0.2
    market_tag: float = 0.1
    mentions: float = 0.1
    mention_cap: float = 5.0


@dataclass(frozen=True)
class ScoringConfig:
    lexicon: Lexicon = field(default_factory=Lexicon)
    engagement: EngagementWeights = field(default_factory=EngagementWeights)
    signal: SignalWeights = field(default_factory=SignalWeights)
    market_tags: tuple[str, ...] = MARKET_TAGS
