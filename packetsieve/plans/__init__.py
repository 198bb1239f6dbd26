from .analyse import analyse_capture, analyse_range
from .score import score, score_report
from .train import train

__all__ = ["analyse_capture", "analyse_range", "score", "score_report", "train"]
