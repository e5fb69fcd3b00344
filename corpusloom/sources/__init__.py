"""Where files come from: source trees and tables."""
