import os
import sys

here = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, here)
os.environ["PYTHONPATH"] = f"{here}:{os.environ.get('PYTHONPATH', '')}"
