"""Whole searches: transits, spots, timelines, occlusion, screens."""
