"""Evaluation-record analytics and graph/geometry comparison as DataFrame programs."""
